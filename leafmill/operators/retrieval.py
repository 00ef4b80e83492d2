"""Corpus operators: chunking, change detection, ranking, fusion and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ordered import global_row_number
from leafmill.session import where_computed, written

_BLANK = " \t\r\n"


def _hard_split(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, found in one run over the text; an empty text is one piece."""
    return F.when(text == "", F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0)))


#: Chunks that a fold gathers before it puts them away, so that no array grows with the text.
_HELD = 256


def _put_away(out: Column, done: Column) -> list[Column]:
    """``out`` and ``done`` (filled arrays) after a step."""
    full = F.size(out) >= _HELD
    return [F.when(full, F.slice(out, F.lit(1), F.lit(0))).otherwise(out).alias("out"), F.when(full, F.concat(done, F.array(out))).otherwise(done).alias("done")]


def _sentences(text: Column, limit: int) -> Column:
    """The text itself, or its sentences (cut further when over the limit)."""
    parts = F.flatten(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: _hard_split(s, limit)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(parts)


def paragraph_chunks(
    documents: DataFrame, target: int = 800, limit: int = 1400, least: int = 200, separator: str = r"\n{2,}"
) -> DataFrame:
    """Chunks (doc_id, chunk_idx, chunk): paragraphs gathered until ``target`` characters, none over ``limit``;
    a last chunk under ``least`` joins the one before when that fits. ``separator`` splits paragraphs."""
    filled = F.filter(F.split("text", separator), lambda p: F.trim(p, F.lit(_BLANK)) != "")
    pieces = F.flatten(F.transform(F.transform(filled, lambda p: F.trim(p, F.lit(_BLANK))), lambda p: _sentences(p, limit)))
    state = "struct<buf:string,out:array<string>,done:array<array<string>>>"

    def gather(s: Column, p: Column) -> Column:
        empty = s["buf"] == ""
        over = ~empty & (F.length(s["buf"]) + 2 + F.length(p) > limit)
        out = F.when(over, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])
        buf = F.when(empty | over, p).otherwise(F.concat(s["buf"], F.lit("\n\n"), p))
        full = F.length(buf) >= target
        return F.struct(F.when(full, "").otherwise(buf).alias("buf"), *_put_away(F.when(full, F.concat(out, F.array(buf))).otherwise(out), s["done"]))

    def finish(s: Column) -> Column:
        return F.struct(s["buf"].alias("buf"), F.concat(F.flatten(s["done"]), s["out"]).alias("out"))

    start = F.from_json(F.lit('{"buf":"","out":[],"done":[]}'), state)
    work = documents.select("doc_id", F.aggregate(pieces, start, gather, finish).alias("s"))
    tail = F.col("s.buf")
    joins = (F.size("s.out") > 0) & (F.length(tail) < least) & (F.length(F.try_element_at("s.out", F.lit(-1))) + 2 + F.length(tail) <= limit)
    merged = F.concat(
        F.slice("s.out", F.lit(1), F.greatest(F.size("s.out") - 1, F.lit(0))), F.array(F.concat(F.try_element_at("s.out", F.lit(-1)), F.lit("\n\n"), tail))
    )
    chunks = F.when(tail == "", F.col("s.out")).when(joins, merged).otherwise(F.concat("s.out", F.array(tail)))
    return work.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "chunk"))


def heading_chunks(
    documents: DataFrame, tokens: int = 512, overlap: int = 128, limit: int = 10_000, separator: str = r"\n\s*\n"
) -> DataFrame:
    """Chunks (doc_id, chunk_idx, chunk, breadcrumb, token_count) of about ``tokens`` tokens (four characters
    each); a chunk starts with the last ``overlap`` tokens of the one before and carries the headings above it.
    Chunks over ``limit`` characters are cut at sentences."""
    paragraphs = F.filter(F.split("text", separator), lambda p: F.trim(p, F.lit(_BLANK)) != "")
    state = "struct<buf:string,crumb:string,heads:array<struct<level:int,title:string>>,out:array<struct<chunk:string,crumb:string>>,done:array<array<struct<chunk:string,crumb:string>>>>"

    def crumb(heads: Column) -> Column:
        return F.array_join(F.transform(heads, lambda h: h["title"]), " > ")

    def gather(s: Column, p: Column) -> Column:
        marks = F.regexp_extract(p, r"^(#{1,6})\s", 1)
        head = F.struct(F.length(marks).alias("level"), F.trim(F.regexp_extract(p, r"^#{1,6}\s+([^\n]*)", 1)).alias("title"))
        heads = F.when(
            marks != "", F.concat(F.filter(s["heads"], lambda h: h["level"] < F.length(marks)), F.array(head))
        ).otherwise(s["heads"])
        full = (s["buf"] != "") & (F.floor((F.length(s["buf"]) + 2 + F.length(p)) / 4) > tokens)
        done = F.struct(s["buf"].alias("chunk"), s["crumb"].alias("crumb"))
        kept = F.right(s["buf"], F.lit(overlap * 4))
        buf = F.when(s["buf"] == "", p).otherwise(F.concat(F.when(full, kept).otherwise(s["buf"]), F.lit("\n\n"), p))
        return F.struct(
            buf.alias("buf"), F.when((s["buf"] == "") | full, crumb(heads)).otherwise(s["crumb"]).alias("crumb"), heads.alias("heads"),
            *_put_away(F.when(full, F.concat(s["out"], F.array(done))).otherwise(s["out"]), s["done"]),
        )

    def finish(s: Column) -> Column:
        return F.struct(s["buf"].alias("buf"), s["crumb"].alias("crumb"), F.concat(F.flatten(s["done"]), s["out"]).alias("out"))

    start = F.from_json(F.lit('{"buf":"","crumb":"","heads":[],"out":[],"done":[]}'), state)
    folded = documents.select("doc_id", F.aggregate(paragraphs, start, gather, finish).alias("s"))
    rest = F.struct(F.col("s.buf").alias("chunk"), F.col("s.crumb").alias("crumb"))
    chunks = F.when(F.col("s.buf") == "", F.col("s.out")).otherwise(F.concat("s.out", F.array(rest)))
    cut = F.flatten(
        F.transform(chunks, lambda c: F.transform(_sentences(c["chunk"], limit), lambda t: F.struct(t.alias("chunk"), c["crumb"].alias("crumb"))))
    )
    rows = folded.select("doc_id", F.posexplode(cut).alias("chunk_idx", "c"))
    return rows.select(
        "doc_id", "chunk_idx", "c.chunk", F.col("c.crumb").alias("breadcrumb"), F.floor(F.length("c.chunk") / 4).alias("token_count")
    )


def window_chunks(documents: DataFrame, size: int = 8000, overlap: int = 400, most: int | None = None) -> DataFrame:
    """Character windows (doc_id, chunk_idx, start, chunk) with overlap; a window ends at the last white space
    of its second half. ``most`` limits chunks per document where an index demands it; default whole texts."""
    shortest = size // 2 - overlap
    state = "struct<at:int,out:array<struct<start:int,chunk:string>>,done:array<array<struct<start:int,chunk:string>>>>"

    def walk(blocks: Column) -> Column:
        """The windows over blocks of ``size`` characters; a window lies in two of them at most."""
        total = F.when(F.size(blocks) > 0, (F.size(blocks) - 1) * size + F.length(F.element_at(blocks, -1))).otherwise(0)

        def step(s: Column, _: Column) -> Column:
            block = F.floor(s["at"] / size).cast("int")
            window = F.substring(F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit(""))), s["at"] - block * size + 1, F.lit(size))
            last = s["at"] + size >= total
            blank = F.length(F.regexp_extract(window, r"(?s)^(.*)\s", 1))
            length = F.when(last, total - s["at"]).when(blank > size // 2, blank).otherwise(F.lit(size))
            item = F.struct(s["at"].alias("start"), F.left(window, length).alias("chunk"))
            ended = s["at"] >= total
            out = F.when(ended, s["out"]).otherwise(F.concat(s["out"], F.array(item)))
            after = F.when(ended, s["at"]).when(last, total).otherwise((s["at"] + length - overlap).cast("int")).cast("int")
            return F.struct(after.alias("at"), *_put_away(out, s["done"]))

        rounds = F.sequence(F.lit(1), F.floor(total / shortest).cast("int") + 1)
        return F.aggregate(rounds, F.from_json(F.lit('{"at":0,"out":[],"done":[]}'), state), step, lambda s: F.concat(F.flatten(s["done"]), s["out"]))

    # the blocks are made once, as the element of an array
    chunks = F.transform(F.array(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))), walk)[0]
    if most is not None:
        chunks = F.slice(chunks, F.lit(1), F.lit(most))
    rows = documents.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "c"))
    return rows.select("doc_id", "chunk_idx", F.col("c.start").alias("start"), F.col("c.chunk").alias("chunk"))


def change_detection(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, state): new, changed, unchanged or deleted by content hash; texts are hashed before the join."""
    a = old.select(key, F.sha2("text", 256).alias("h0"))
    b = new.select(key, F.sha2("text", 256).alias("h1"))
    state = (
        F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "deleted")
        .when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def cache_verdicts(materials: DataFrame, cache: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, verdict): HIT, MISS:no_entry, MISS:hash_changed or MISS:no_source.

    materials: path, content; cache: path, hash, source_page; pages: source_page. The hash covers path, NUL
    and content.
    """
    current = materials.select("path", F.sha2(F.concat("path", F.lit("\u0000"), "content"), 256).alias("__h"))
    have = pages.select("source_page").distinct().withColumn("__page", F.lit(True))
    joined = current.join(cache.withColumn("__entry", F.lit(True)), "path", "left").join(have, "source_page", "left")
    verdict = (
        F.when(F.col("__entry").isNull(), "MISS:no_entry").when(F.col("__h") != F.col("hash"), "MISS:hash_changed")
        .when(F.col("__page").isNull(), "MISS:no_source").otherwise("HIT")
    )
    return joined.select("path", verdict.alias("verdict"))


def chunk_reuse(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks (slug, chunk_idx, chunk) with their 16-digit ``hash`` and whether the stored one is ``reused``."""
    hashed = chunks.withColumn("hash", F.substring(F.sha2("chunk", 256), 1, 16))
    kept = stored.select("slug", "chunk_idx", F.col("hash").alias("__old"))
    return hashed.join(kept, ["slug", "chunk_idx"], "left").withColumn(
        "reused", F.coalesce(F.col("__old") == F.col("hash"), F.lit(False))
    ).drop("__old")


def bm25(documents: DataFrame, terms: Sequence[str], k1: float = 1.5, b: float = 0.75, base: Column | None = None) -> DataFrame:
    """(doc_id, score) of documents holding any of the terms, over ``[a-z0-9]+`` tokens, plus half the base score.

    Terms are counted in the text with single blanks between tokens, so nothing is exploded or shuffled; corpus
    statistics are one row.
    """
    words = list(dict.fromkeys(terms))
    tokens = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    blanks = F.length("tokens") - F.length(F.replace("tokens", F.lit(" "), F.lit("")))
    padded = F.concat(F.lit(" "), F.replace("tokens", F.lit(" "), F.lit("  ")), F.lit(" "))

    def occurrences(word: str) -> Column:
        rest = F.replace("padded", F.lit(f" {word} "), F.lit(""))
        return ((F.length("padded") - F.length(rest)) / (len(word) + 2)).cast("int")

    spaced = documents.select("doc_id", tokens.alias("tokens"), (F.lit(0.0) if base is None else base).alias("base"))
    counted = (
        spaced.withColumn("padded", padded)
        .select(
            "doc_id", F.when(F.col("tokens") == "", 0).otherwise(blanks + 1).alias("len"),
            *[occurrences(w).alias(f"t{i}") for i, w in enumerate(words)], "base",
        )
    )
    stats = counted.agg(
        F.struct(
            F.count("*").alias("n"), F.avg("len").alias("avg"),
            *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(words))],
        ).alias("s")
    ).scalar()
    told = counted.withColumn("s", stats)
    score = F.col("base") * 0.5
    for i in range(len(words)):
        tf, df = F.col(f"t{i}"), F.col(f"s.d{i}")
        idf = F.log(1 + (F.col("s.n") - df + 0.5) / (df + 0.5))
        norm = tf + k1 * (1 - b + b * F.col("len") / F.col("s.avg"))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / norm).otherwise(0.0)
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"t{i}") > 0)
    return where_computed(told, hit).select("doc_id", score.alias("score"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def cosine_top_k(vectors: DataFrame, query: Column, k: int = 30, floor: float = 0.0) -> DataFrame:
    """The k vectors (vec_id, score) nearest to one query vector, at or above the floor: a bounded top-k."""
    asked = vectors.select("vec_id", "embedding", query.alias("__q"))
    scored = asked.select("vec_id", cosine(F.col("embedding"), F.col("__q")).alias("score")).where(F.col("score") >= floor)
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(k)


def cosine_top_k_per_group(vectors: DataFrame, queries: DataFrame, group: str, k: int = 15, floor: float = 0.0) -> DataFrame:
    """Per group the k vectors nearest to the group's query; ranks are cut per task before the shuffle."""
    scored = vectors.join(queries.select(group, F.col("embedding").alias("__q")), group).select(
        group, "vec_id", cosine(F.col("embedding"), F.col("__q")).alias("score")
    ).where(F.col("score") >= floor)
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank_hits(hits: DataFrame, lexical: DataFrame, keep: int = 12, weight: float = 0.5) -> DataFrame:
    """The second cut after ``cosine_top_k``: of the hits (doc_id, score) the ``keep`` best by ``weight`` × similarity + (1 - ``weight``) × lexical
    score over the best lexical score of the hits. lexical: doc_id, score; a hit without one counts 0. Ties by id."""
    told = hits.select("doc_id", "score").join(lexical.select("doc_id", F.col("score").alias("__l")), "doc_id", "left")
    best = F.max("__l").over(Window.partitionBy())  # a row for each hit
    share = F.when(best > 0, F.coalesce("__l", F.lit(0.0)) / best).otherwise(0.0)
    return told.withColumn("score", weight * F.col("score") + (1 - weight) * share).drop("__l").orderBy(F.col("score").desc(), "doc_id").limit(keep)


def rank_scores(scores: DataFrame, out: str) -> DataFrame:
    """1-based rank over the whole table by falling score, ids on ties, without a one-task sort."""
    return global_row_number(scores, [F.col("score").desc(), F.col("doc_id")], out).select("doc_id", (F.col(out) + 1).alias(out))


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """(doc_id, score) from two ranked lists (doc_id, rank): 1/(k + rank), summed."""
    a, b = first.select("doc_id", F.col("rank").alias("ra")), second.select("doc_id", F.col("rank").alias("rb"))
    part = [F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("ra", "rb")]
    return a.join(b, "doc_id", "full_outer").select("doc_id", (part[0] + part[1]).alias("score"))


# Match tiers.
BRACKETS = {"exact_name": 700, "exact_path": 650, "prefix_name": 600, "prefix_segment": 550, "in_name": 500, "in_path": 450}


def lexical_bracket(query: str) -> Column:
    """Tier of a match of ``name`` and ``path`` with the query; -1 without any."""
    q = query.lower()
    name, path = F.lower("name"), F.lower("path")
    segments = F.split(path, "/")
    return (
        F.when(name == q, BRACKETS["exact_name"]).when(path == q, BRACKETS["exact_path"])
        .when(name.startswith(q), BRACKETS["prefix_name"])
        .when(F.exists(segments, lambda s: s.startswith(q)), BRACKETS["prefix_segment"])
        .when(name.contains(q), BRACKETS["in_name"]).when(path.contains(q), BRACKETS["in_path"]).otherwise(-1)
    )


def tiered_results(pages: DataFrame, query: str, gap: int = 1000, caps: dict[str, int] | None = None) -> DataFrame:
    """Pages (name, path, body in [0,1]) by tier × 1000 + body score; a category named in ``caps`` (lexical, body,
    path_only) shows its first so many. Hidden paths count half."""
    bracket = lexical_bracket(query)
    hidden = F.col("path").rlike(r"(^|/)\.")
    scored = pages.withColumn("bracket", bracket).where((F.col("bracket") > 0) | (F.col("body") > 0))
    category = F.when(F.col("bracket") == BRACKETS["in_path"], "path_only").when(F.col("bracket") > 0, "lexical").otherwise("body")
    score = (F.greatest("bracket", F.lit(0)) * gap + F.col("body")) * F.when(hidden, 0.5).otherwise(1.0)
    told = scored.withColumns({"category": category, "score": score})
    if not caps:
        return told
    w = Window.partitionBy("category").orderBy(F.col("score").desc(), "path")
    ranked = told.withColumn("__r", F.row_number().over(w))
    shown = F.lit(True)
    for name, cap in caps.items():
        shown = shown & ((F.col("category") != name) | (F.col("__r") <= cap))
    return ranked.where(shown).drop("__r")


# Weights of matched fields and tiers.
FIELD_SCORES = {"exact": 10.0, "title": 6.0, "tags": 4.0, "summary": 2.0}
TIER_WEIGHTS = {"core": 1.3, "supporting": 1.0, "peripheral": 0.7}


def field_match_score(term: str) -> Column:
    """Score of a page (slug, title, tags, summary, degree, tier) for a term; matches gain a degree bonus up to 2
    and the tier's weight."""
    t = term.lower()
    title = F.lower("title")
    field = (
        F.when((F.lower("slug") == t) | (title == t), FIELD_SCORES["exact"]).when(title.contains(t), FIELD_SCORES["title"])
        .when(F.array_contains(F.transform("tags", lambda x: F.lower(x)), t), FIELD_SCORES["tags"])
        .when(F.lower("summary").contains(t), FIELD_SCORES["summary"]).otherwise(0.0)
    )
    weight = F.when(F.col("tier") == "core", TIER_WEIGHTS["core"]).when(F.col("tier") == "peripheral", TIER_WEIGHTS["peripheral"]).otherwise(1.0)
    return F.when(field > 0, (field + F.least(F.col("degree") * 0.1, F.lit(2.0))) * weight).otherwise(0.0)


# Words a query token list leaves out.
STOP_WORDS = ["a", "an", "and", "are", "in", "is", "of", "on", "or", "the", "to", "what", "with"]
TITLE_BONUS = 10


# Endings that a stem does without.
STEM_ENDINGS = ["ings", "ing", "edly", "ed", "ies", "es", "ly", "s"]


def stem(word: Column) -> Column:
    """An English word without its ending, where three letters or more are left."""
    return F.regexp_replace(word, rf"^([a-z]{{3,}}?)({'|'.join(STEM_ENDINGS)})$", "$1")


def query_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS, stems: bool = False) -> Column:
    """Search tokens: words without stop words, with ``stems`` cut to their stems; CJK runs whole, as pairs and as single characters."""
    lower = F.lower(text)
    words = F.filter(F.regexp_extract_all(lower, F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(*stop_words))
    words = F.transform(words, stem) if stems else words
    runs = F.regexp_extract_all(lower, F.lit(r"([一-鿿]+)"), F.lit(1))

    def grams(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(run), pairs, singles)

    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, grams))))


def token_match_score(query: str, title: Column, body: Column, stop_words: Sequence[str] = STOP_WORDS, stems: bool = False) -> Column:
    """Number of query tokens in the body, plus 10 for each in the title. With ``stems`` any form of a word is a hit."""
    tokens = query_tokens(F.lit(query), stop_words, stems)
    def hits(text: Column) -> Column:
        return F.size(F.filter(tokens, lambda t: F.lower(text).contains(t)))
    return hits(body) + hits(title) * TITLE_BONUS


def budgeted(items: DataFrame, group: Sequence[str], budget: Column | int, score: str = "score", key: str = "doc_id", size: str = "size") -> DataFrame:
    """Items by falling score per group (ties by ``key``) while their running length fits the budget; sizes are not negative.

    Rows are dealt out by ranges of (group, score), so a group of any size is spread over tasks. The lengths of the ranges, a row for
    each group in a range, give the length before each; ranges that begin beyond the budget are left out unread.
    """
    order = [F.col(score).desc(), F.col(key)]
    ranged = written(items.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    keys = [F.struct(F.lit(1), *group).alias("__g"), "__part"]  # a struct of nulls is no null
    lengths = ranged.groupBy(*keys).agg(F.sum(size).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = lengths.select("__g", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    limit = F.lit(budget) if isinstance(budget, int) else budget
    told = ranged.withColumn("__g", keys[0]).join(starts, ["__g", "__part"]).where(F.col("__before") <= limit)
    inside = Window.partitionBy("__g", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = F.col("__before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return told.withColumn("running", running).where(F.col("running") <= limit).drop("__g", "__part", "__before")


def confidence(evidence: DataFrame, pages: DataFrame, today: Column, stale_days: int = 90) -> DataFrame:
    """Pages (page, updated) with confidence = 0.5·min(lineages/3, 1) + 0.5·mean quality per lineage, and
    whether they are stale. evidence: page, lineage, quality."""
    lineages = evidence.groupBy("page", "lineage").agg(F.avg("quality").alias("q"))
    scored = lineages.groupBy("page").agg(
        (F.least(F.count("*") / 3, F.lit(1.0)) * 0.5 + F.avg("q") * 0.5).alias("confidence")
    )
    return pages.join(scored, "page", "left").select(
        "page", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (F.datediff(today, F.col("updated")) > stale_days).alias("stale")
    )


def similar_names(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (name, candidate, score): 1.0 for equal normalised names, 0.85 when one contains the other as words
    (shorter of at least two), the token Jaccard from 0.7, 0.4 + (j − 0.4)/2 from 0.4.

    Names meet through shared tokens. Every pair at 0.4 or above shares a token among the rarest of each name
    (a name's rarest ⌊0.6·n⌋ + 1 tokens), so common tokens do not multiply.
    """
    def tokens(c: Column) -> Column:
        return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9一-鿿]+)"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS)))

    a = names.select("name").distinct().withColumn("ta", tokens(F.col("name")))
    b = candidates.select("candidate").distinct().withColumn("tb", tokens(F.col("candidate")))
    counts = a.select(F.explode("ta").alias("t")).unionAll(b.select(F.explode("tb").alias("t"))).groupBy("t").agg(F.count("*").alias("c"))

    def rare(df: DataFrame, key: str, column: str) -> DataFrame:
        long = df.select(key, column, F.explode(column).alias("t")).join(counts, "t")
        ranked = long.groupBy(key, column).agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("r"))
        keep = F.floor(F.size("r") * 0.6).cast("int") + 1
        return ranked.select(key, column, F.explode(F.slice("r", F.lit(1), keep)).alias("x")).select(key, column, F.col("x.t").alias("t"), F.col("x").alias("rarity"))

    ra, rb = rare(a, "name", "ta"), rare(b, "candidate", "tb")
    all_a = a.select("name", "ta", F.explode("ta").alias("t"))
    # a name lying in another as a phrase shares its rarest token with it
    first_b = rb.groupBy("candidate", "tb").agg(F.min("rarity")["t"].alias("t"))
    all_b = b.select("candidate", "tb", F.explode("tb").alias("t"))
    first_a = ra.groupBy("name", "ta").agg(F.min("rarity")["t"].alias("t"))
    pairs = (
        ra.drop("rarity").join(rb.drop("rarity"), "t").unionByName(all_a.join(first_b, "t")).unionByName(first_a.join(all_b, "t"))
        .select("name", "candidate", "ta", "tb").distinct()
    )
    common, union = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    j = common / union
    sa, sb = F.concat(F.lit(" "), F.array_join("ta", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("tb", " "), F.lit(" "))
    phrase = (sa.contains(sb) & (F.size("tb") >= 2)) | (sb.contains(sa) & (F.size("ta") >= 2))
    score = F.when(sa == sb, 1.0).when(phrase, 0.85).when(j >= 0.7, j).when(j >= 0.4, 0.4 + (j - 0.4) * 0.5)
    return pairs.withColumn("score", score).where("score is not null").select("name", "candidate", "score")


_FIELD_OPERATORS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def find_entities(entities: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Entities whose fields meet every pattern (``>=4``, ``!=x``, ``x``); list fields must hold the value."""
    from pyspark.sql import types as T

    out = entities
    for field, pattern in filters.items():
        op = next((o for o in (">=", "<=", "!=", ">", "<", "=") if pattern.startswith(o)), "=")
        value = pattern[len(op):] if pattern.startswith(op) else pattern
        if isinstance(entities.schema[field].dataType, T.ArrayType):
            out = out.where(F.array_contains(field, value))
        else:
            typed = F.lit(value).cast(entities.schema[field].dataType)
            out = out.where(getattr(F.col(field), _FIELD_OPERATORS[op])(typed))
    return out


def proposed_without(ideas: DataFrame, experiments: DataFrame) -> DataFrame:
    """Proposed ideas that no experiment names."""
    return ideas.where("status = 'proposed'").join(experiments.select("idea_id").distinct(), "idea_id", "left_anti")


def source_coverage(pages: DataFrame, exempt: Sequence[str]) -> DataFrame:
    """Class of the ``sources`` JSON of a page (page, type, sources): ok, missing, empty, invalid, not applicable."""
    listed = F.from_json("sources", "array<string>")
    kind = (
        F.when(F.col("type").isin(*exempt), "not_applicable").when(F.col("sources").isNull(), "missing_sources")
        .when(listed.isNull(), "invalid_sources").when(F.size(listed) == 0, "empty_sources").otherwise("ok")
    )
    return pages.select("page", kind.alias("coverage"))


def project_edges(records: DataFrame, kind: str, fields: Sequence[str]) -> DataFrame:
    """Link fields (single or list) of records as edges (from, to, type)."""
    from functools import reduce

    from pyspark.sql import types as T

    parts = []
    for f in fields:
        listed = F.col(f) if isinstance(records.schema[f].dataType, T.ArrayType) else F.array(f)
        parts.append(
            records.select(F.col("id").alias("from"), F.explode(listed).alias("to")).where("`to` is not null")
            .withColumn("type", F.lit(f"fm_{kind}_{f}"))
        )
    return reduce(DataFrame.unionByName, parts)
