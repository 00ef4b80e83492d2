"""Link graphs: extraction, backlinks, lint, edges, traversal, communities.

Links are rows (src, dst); adjacency is shuffled by node, and per-edge measures that need neighbours go through
joins on the shared node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import checkpointed, dealt, dealt_as, task_count, written

# Wiki link and Markdown link.
WIKI_LINK = r"\[\[([^\n#\[\]|]+)(?:#([^\n\[\]|]+))?(?:\|([^\n\[\]]+))?\]\]"
MARKDOWN_LINK = r"\[([^\]\n]*)\]\((<[^>\n]+>|[^)\s\n]+)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^)\n]*\)))?\)"


def extract_links(pages: DataFrame) -> DataFrame:
    """(page, target, external): wiki links and Markdown links of pages (page, text). Anchors are cut off, and
    internal targets lose ``./`` and ``.md``."""
    wiki = F.transform(
        F.regexp_extract_all("text", F.lit(WIKI_LINK), F.lit(1)), lambda t: F.struct(F.trim(t).alias("target"), F.lit(False).alias("external"))
    )

    def target(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"^<(.*)>$", "$1")
        external = bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
        inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"#.*$", ""), r"^\./", ""), r"\.md$", "")
        return F.struct(F.when(external, bare).otherwise(inner).alias("target"), external.alias("external"))

    markdown = F.transform(F.regexp_extract_all("text", F.lit(MARKDOWN_LINK), F.lit(2)), target)
    return pages.select("page", F.explode(F.concat(wiki, markdown)).alias("l")).select("page", "l.*").where("target <> ''")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links with ``resolved``: the page of that name, case ignored (null when missing); links of a page
    to itself are dropped. Equal links of a page count once."""
    names = pages.select(F.lower("page").alias("__k"), F.col("page").alias("resolved")).groupBy("__k").agg(F.min("resolved").alias("resolved"))
    own = F.lower("page") != F.lower("target")
    distinct = links.where(~F.col("external") & own).select("page", "target").distinct()
    return distinct.withColumn("__k", F.lower("target")).join(names, "__k", "left").drop("__k")


def backlinks(resolved: DataFrame) -> DataFrame:
    """(target, sources, n): pages linking to each target."""
    return resolved.groupBy(F.coalesce("resolved", "target").alias("target")).agg(
        F.array_sort(F.collect_set("page")).alias("sources"), F.count_distinct("page").alias("n")
    )


def link_index(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(page, kind, other): the link index of a wiki, a row for each entry.

    ``forward``: a page of the wiki that the page links to; ``backlink``: a page that links to it; ``missing``: a name no page
    has; ``external``: an address outside. Equal entries count once. A hub's entries are rows, never one array.
    """
    inside = resolved.where("resolved is not null")
    parts = [
        inside.select("page", F.lit("forward").alias("kind"), F.col("resolved").alias("other")),
        inside.select(F.col("resolved").alias("page"), F.lit("backlink").alias("kind"), F.col("page").alias("other")),
        resolved.where("resolved is null").select("page", F.lit("missing").alias("kind"), F.col("target").alias("other")),
        links.where("external").select("page", F.lit("external").alias("kind"), F.col("target").alias("other")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def link_lint(pages: DataFrame, resolved: DataFrame, phantom: int = 3) -> DataFrame:
    """(kind, name): broken links, orphans (no link in), dead ends (no link out), phantom hubs (missing pages
    named by at least three pages)."""
    broken = resolved.where("resolved is null")
    parts = [
        broken.select(F.lit("broken_link").alias("kind"), F.concat_ws(" -> ", "page", "target").alias("name")),
        pages.join(resolved.select(F.col("resolved").alias("page")), "page", "left_anti").select(F.lit("orphan").alias("kind"), F.col("page").alias("name")),
        pages.join(resolved.where("resolved is not null").select("page"), "page", "left_anti").select(F.lit("dead_end").alias("kind"), F.col("page").alias("name")),
        broken.groupBy(F.lower("target").alias("name")).agg(F.count_distinct("page").alias("n")).where(F.col("n") >= phantom)
        .select(F.lit("phantom_hub").alias("kind"), "name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def index_consistency(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, problem): listed but missing, present but unlisted, or a title used by several pages."""
    a, b = index.select("page").distinct().withColumn("__i", F.lit(1)), pages.select("page").distinct().withColumn("__p", F.lit(1))
    sides = a.join(b, "page", "full_outer").select(
        "page", F.when(F.col("__p").isNull(), "missing_page").when(F.col("__i").isNull(), "not_indexed").alias("problem")
    ).where("problem is not null")
    titles = pages.groupBy(F.lower("title").alias("__t")).agg(F.count("*").alias("n"), F.min("page").alias("page")).where("n > 1")
    return sides.unionAll(titles.select("page", F.lit("duplicate_title").alias("problem")))


def field_completeness(pages: DataFrame, required: list[str], warn: list[str]) -> DataFrame:
    """(page, verdict): fail when a required field is missing, warn for the others, else pass."""
    def missing(fields: list[str]) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "")
        return out

    return pages.select("page", F.when(missing(required), "fail").when(missing(warn), "warn").otherwise("pass").alias("verdict"))


def degrees(links: DataFrame) -> DataFrame:
    """In, out and total degree per node. Each edge adds to two counts that combine before the shuffle."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(
        F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree")
    )


def hubs(degree: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Nodes with a degree above the mean plus ``sigmas`` standard deviations."""
    limit = degree.agg((F.avg("degree") + sigmas * F.stddev_pop("degree")).alias("l")).scalar()
    return degree.where(F.col("degree") > limit)


def top_nodes(degree: DataFrame, n: int = 20) -> DataFrame:
    return degree.orderBy(F.col("degree").desc(), "node").limit(n)


def deduplicate_edges(edges: DataFrame, symmetric: list[str], order: str = "seq") -> DataFrame:
    """First edge of each (from, to, type) in ``order``; symmetric types have their ends sorted first."""
    both = F.col("type").isin(*symmetric)
    sorted_ = edges.withColumns(
        {"from": F.when(both, F.least("from", "to")).otherwise(F.col("from")), "to": F.when(both, F.greatest("from", "to")).otherwise(F.col("to"))}
    )
    w = Window.partitionBy("from", "to", "type").orderBy(order)
    return sorted_.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_edge_confidence(edges: DataFrame) -> DataFrame:
    """One edge per (from, to); a stated confidence replaces none, the strongest wins."""
    return edges.groupBy("from", "to").agg(F.max("confidence").alias("confidence"))


def undirected(links: DataFrame) -> DataFrame:
    """Both directions of every link, loops and repeats removed. Links are written once, as they are counted for the partitions."""
    links = written(links.select("src", "dst"))
    both = links.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
    return dealt(both.select("e.a", "e.b").where("a <> b"), "a", "b").distinct()


def neighbourhood(links: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """(node, depth): nodes reachable from the seeds (node) in at most ``depth`` steps, by rounds of joins with
    the frontier; visited nodes are left out by an anti-join."""
    if direction == "both":
        steps = written(undirected(links))
    elif direction == "out":
        steps = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    else:
        steps = links.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    steps = dealt(steps, "a") if direction == "both" else steps
    seen = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        reached = steps.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def shortest_paths(links: DataFrame, seeds: DataFrame, max_hops: int = 4) -> DataFrame:
    """(node, hops) from the seeds along links in both directions, at most four hops."""
    return neighbourhood(links, seeds, max_hops).withColumnRenamed("depth", "hops")


def typed_paths(edges: DataFrame, seeds: DataFrame, max_hops: int = 4, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(node, hops, path, types, directions): a shortest path from the seeds (node) to every node within ``max_hops``.

    edges: src, dst, type; ``types`` keeps some of them. ``path`` holds the nodes from the seed on, ``types`` and ``directions`` (``out``
    along an edge, ``in`` against it) one entry a step. Of several last steps the one from the smallest node, then of the least
    type and direction, is taken: a node keeps that pointer, found by a minimum that combines before the shuffle, and then
    fetches the path of the node it points to, so a hub's edges never carry paths.
    """
    kept = edges if types is None else edges.where(F.col("type").isin(*types))
    out = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", F.lit("out").alias("direction"))
    into = kept.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type", F.lit("in").alias("direction"))
    steps = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    none = F.array().cast("array<string>")
    seen = checkpointed(seeds.select("node").distinct().select("node", F.lit(0).alias("hops"), F.array("node").alias("path"), none.alias("types"), none.alias("directions")))
    frontier = seen
    for hop in range(1, max_hops + 1):
        ends = frontier.select(F.col("node").alias("a"))
        pointed = steps.join(ends, "a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "type", "direction")).alias("step"))
        fresh = pointed.join(seen.select("node"), "node", "left_anti").withColumn("a", F.col("step.a"))
        before = frontier.select(F.col("node").alias("a"), F.col("path").alias("p"), F.col("types").alias("t"), F.col("directions").alias("d"))
        frontier = checkpointed(
            fresh.join(before, "a").select(
                "node", F.lit(hop).alias("hops"), F.concat("p", F.array("node")).alias("path"),
                F.concat("t", F.array("step.type")).alias("types"), F.concat("d", F.array("step.direction")).alias("directions"),
            )
        )
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


#: Members that one list of ``shared_members`` holds at most.
LISTED = 512


def shared_members(edges: DataFrame, members: DataFrame, listed: int = LISTED) -> DataFrame:
    """(a, b, member) for every member (node, member, distinct) that both ends of an edge (a, b, distinct) have.

    Each edge takes the members of the end that has fewer to the other end, so what travels is the sum of the smaller sizes. Where the
    end with more has at most ``listed``, they travel as one list an edge, and only shared ones become rows. Members of larger
    ends are looked up by (end, member): a hub is looked up, and sent only for edges to still larger hubs.
    """
    size = members.groupBy("node").agg(F.count("*").alias("n"))
    sized = edges.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    lower = F.col("na") <= F.col("nb")
    turned = sized.select(
        "a", "b", F.when(lower, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("many"),
        F.greatest("na", "nb").alias("most"),
    )
    lists = members.join(size.where(F.col("n") <= listed), "node").groupBy("node").agg(F.collect_list("member").alias("list"))
    sent = turned.where(F.col("most") <= listed).join(lists.toDF("few", "sent"), "few")
    met = sent.join(lists.toDF("many", "held"), "many").select("a", "b", F.explode(F.array_intersect("sent", "held")).alias("member"))
    single = turned.where(F.col("most") > listed).join(members.toDF("few", "member"), "few")
    return met.unionByName(single.join(members.toDF("many", "member"), ["many", "member"]).select("a", "b", "member"))


def co_citation(links: DataFrame) -> DataFrame:
    """(a, b, co_citation) for linked pairs: shared in-links over the larger in-degree.

    Only linked pairs matter; each meets the in-links of the end that has fewer.
    """
    edges = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    cited = links.select("src", "dst").distinct()
    inn = cited.groupBy("dst").agg(F.count("*").alias("n"))
    shared = shared_members(edges, cited.select(F.col("dst").alias("node"), F.col("src").alias("member"))).groupBy("a", "b").agg(F.count("*").alias("k"))
    sized = edges.join(shared, ["a", "b"], "left").join(inn.toDF("a", "na"), "a", "left").join(inn.toDF("b", "nb"), "b", "left")
    most = F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)), F.lit(1))
    return sized.select("a", "b", (F.coalesce("k", F.lit(0)) / most).alias("co_citation"))


def _shared_sources(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(a, b, k, na, nb): sources the two ends share, and how many each has. sources: node, source."""
    s = sources.distinct()
    size = s.groupBy("node").agg(F.count("*").alias("n"))
    shared = shared_members(edges, s.toDF("node", "member")).groupBy("a", "b").agg(F.count("*").alias("k"))
    return edges.join(shared, ["a", "b"], "left").join(size.toDF("a", "na"), "a", "left").join(size.toDF("b", "nb"), "b", "left")


def edge_weights(links: DataFrame, sources: DataFrame, affinity: Column, types: DataFrame) -> DataFrame:
    """(a, b, weight): mean of co-citation, source overlap (where both ends have sources) and type affinity.

    types: node, type; ``affinity`` is a Column over type_a and type_b.
    """
    pairs = co_citation(links)
    told = _shared_sources(pairs.select("a", "b"), sources)
    overlap = F.when(F.col("na").isNotNull() & F.col("nb").isNotNull(), F.coalesce("k", F.lit(0)) / F.least("na", "nb"))
    typed = (
        pairs.join(told.select("a", "b", overlap.alias("overlap")), ["a", "b"])
        .join(types.toDF("a", "type_a"), "a", "left").join(types.toDF("b", "type_b"), "b", "left")
        .withColumn("affinity", affinity)
    )
    known = F.array_compact(F.array("co_citation", "overlap", F.col("affinity").cast("double")))
    mean = F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)
    return typed.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("weight"))


def relevance(links: DataFrame, sources: DataFrame, affinity: Column, types: DataFrame) -> DataFrame:
    """(a, b, relevance) of linked pairs: 3 × direct links + 4 × shared sources + 1.5 × Adamic-Adar + type."""
    directed = links.where("src <> dst").select("src", "dst").distinct()
    edges = directed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("direct"))
    near = undirected(links)
    deg = near.groupBy("a").agg(F.count("*").alias("d"))
    weight = deg.select(F.col("a").alias("member"), (1 / F.log("d")).alias("w")).where("w is not null")
    common = shared_members(edges.select("a", "b"), near.toDF("node", "member")).join(weight, "member").groupBy("a", "b").agg(F.sum("w").alias("aa"))
    told = _shared_sources(edges.select("a", "b"), sources).select("a", "b", F.coalesce("k", F.lit(0)).alias("k"))
    typed = (
        edges.join(common, ["a", "b"], "left").join(told, ["a", "b"])
        .join(types.toDF("a", "type_a"), "a", "left").join(types.toDF("b", "type_b"), "b", "left")
    )
    score = F.col("direct") * 3.0 + F.col("k") * 4.0 + F.coalesce("aa", F.lit(0.0)) * 1.5 + F.coalesce(affinity, F.lit(0.0))
    return typed.select("a", "b", score.alias("relevance"))


def label_propagation(links: DataFrame, patience: int = 8) -> DataFrame:
    """(node, label): every node has a label that none of its neighbours' labels outnumbers, the smallest offered on ties.

    A node wants to change only if another label has strictly more votes than its own. In each round a random half of
    those (by a hash, another one every round) change, so neighbours do not swap labels for ever. When the number that want to change
    has not fallen for ``patience`` rounds, only nodes whose hash is the smallest among such neighbours change from then on: they
    are no neighbours, every change adds agreeing edges, and so the rounds end in a fixpoint in any case. Votes are
    counted before they are shuffled by node, so a hub's neighbours do not meet in one task.
    """
    edges = written(undirected(links))
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    turn, fewest, stale = 0, None, 0
    while True:
        # a node's own label is a vote that counts nothing, so no join brings it back
        own = labels.select(F.col("node").alias("a"), "label", F.lit(0).cast("long").alias("n"), F.lit(True).alias("own"))
        told = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").select("a", "label", F.lit(1).cast("long").alias("n"), F.lit(False).alias("own"))
        votes = told.unionByName(own).groupBy("a", "label").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        best = votes.groupBy("a").agg(
            F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"), F.max(F.when(F.col("own"), F.struct("n", "label"))).alias("mine")
        )
        wish = F.when(-F.col("best.n") > F.col("mine.n"), F.struct(F.col("best.label").alias("new"), F.xxhash64(F.lit(turn), "a").alias("draw")))
        # a written table: a checkpoint keeps what the optimizer inferred of the labels, and that multiplies from round to round in the driver
        state = written(best.select(F.col("a").alias("node"), F.col("mine.label").alias("label"), wish.alias("wish")).select("node", "label", "wish.*"))
        wants = state.where("draw is not null").select(F.col("node").alias("a"), "new", "draw")
        number = wants.count()
        if not number:
            return state.select("node", "label")
        stale = stale if stale >= patience else 0 if fewest is None or number < fewest else stale + 1
        fewest = number if fewest is None else min(fewest, number)
        if stale < patience:
            labels = state.select("node", F.when(F.pmod("draw", F.lit(2)) == 0, F.col("new")).otherwise(F.col("label")).alias("label"))
        else:
            rival = edges.join(wants.select("a"), "a").join(wants.select(F.col("a").alias("b"), F.struct("draw", F.col("a").alias("id")).alias("other")), "b")
            lowest = rival.groupBy("a").agg(F.min("other").alias("other"))
            moves = wants.join(lowest, "a", "left").where(F.col("other").isNull() | (F.struct("draw", F.col("a").alias("id")) < F.col("other")))
            labels = written(state.select("node", "label").join(moves.select(F.col("a").alias("node"), "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        turn += 1


def community_cohesion(links: DataFrame, labels: DataFrame, sparse: float = 0.15) -> DataFrame:
    """(label, size, intra_edges, cohesion, sparse): edges inside a community over the possible ones."""
    edges = undirected(links).where("a < b")
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    inside = edges.join(la, "a").join(lb, "b").where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("intra_edges"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    cohesion = F.when(possible > 0, F.coalesce("intra_edges", F.lit(0)) / possible).otherwise(0.0)
    return sizes.join(inside, "label", "left").select(
        "label", "size", F.coalesce("intra_edges", F.lit(0)).alias("intra_edges"), cohesion.alias("cohesion"), (cohesion < sparse).alias("sparse")
    )


def bridge_nodes(links: DataFrame, labels: DataFrame, communities: int = 3) -> DataFrame:
    """Nodes whose neighbours sit in at least that many communities."""
    edges = written(undirected(links))
    n = task_count(edges)
    told = dealt_as(edges, n, "b").join(labels.toDF("b", "label"), "b")
    return dealt_as(told, n, "a").groupBy(F.col("a").alias("node")).agg(
        F.count_distinct("label").alias("communities")
    ).where(F.col("communities") >= communities)


def surprising_edges(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, score) of edges between communities: 1/sqrt(cross degree × cross degree)."""
    edges = written(undirected(links))
    n = task_count(edges)
    told = dealt_as(edges, n, "a").join(labels.toDF("a", "la"), "a")
    cross = written(dealt_as(told, n, "b").join(labels.toDF("b", "lb"), "b").where("la <> lb").select("a", "b"))
    cd = written(dealt_as(cross, n, "a").groupBy("a").agg(F.count("*").alias("d")))
    one = dealt_as(cross.where("a < b"), n, "a").join(cd.toDF("a", "da"), "a")
    return dealt_as(one, n, "b").join(cd.toDF("b", "db"), "b").select(
        "a", "b", (1 / F.sqrt(F.col("da") * F.col("db"))).alias("score")
    )
