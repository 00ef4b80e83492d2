"""Assets: content-addressed sink, sequential names, path rewriting and descriptions in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import block_quote
from leafmill.operators.ordered import global_row_number

# Fixed value: the line above an injected description.
DESCRIPTION_HEADING = "> **图像说明**"
_REFERENCE = r'(!\[\]\([^)]+\)|src="[^"]+")'


def content_names(assets: DataFrame, extension: Column) -> DataFrame:
    """Add ``hash`` (sha256 of the bytes) and ``name`` (hash plus extension)."""
    hashed = assets.withColumn("hash", F.sha2("bytes", 256))
    return hashed.withColumn("name", F.concat("hash", extension))


def unique_assets(assets: DataFrame, order: list[str]) -> DataFrame:
    """The first reference of every content: the row with the smallest order key per hash. Every task keeps one row of a
    content before anything is shuffled, so the bytes of its repeats do not travel."""
    first = F.min_by(F.struct(*assets.columns), F.struct(*order))
    return assets.groupBy("hash").agg(first.alias("__a")).select("__a.*")


def write_assets(assets: DataFrame, path: str, order: list[str]) -> None:
    """Every content once, as (name, bytes) files in Parquet."""
    unique_assets(assets, order).select("name", "bytes").write.mode("overwrite").parquet(path)


def sequential_names(assets: DataFrame, order: list[str], extension: Column) -> DataFrame:
    """Old name → ``1.ext``, ``2.ext``, … numbered over the whole table in first-seen order of contents."""
    firsts = assets.groupBy("hash").agg(F.min(F.struct(*order, extension.alias("__e"))).alias("o"))
    numbered = global_row_number(firsts.select("hash", "o", F.col("o.__e").alias("__e")), ["o"], "__n")
    names = numbered.select("hash", F.concat((F.col("__n") + 1).cast("string"), F.lower("__e")).alias("new_name"))
    return assets.join(names, "hash")


def reference_statistics(assets: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row: references, unique contents, repeats, described contents."""
    counts = assets.groupBy("hash").agg(F.count("*").alias("n"))
    described = counts.join(descriptions.where("description <> ''").select("hash").distinct().withColumn("d", F.lit(1)), "hash", "left")
    return described.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_refs"), F.count("*").alias("unique"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicates"), F.count("d").alias("described"),
    )


def natural_order(name: Column) -> list[Column]:
    """Sort keys: leading integer of any length (a name without one counts as 99999), then name."""
    digits = F.regexp_extract(name, r"^0*(\d+)", 1)
    number = F.when(digits == "", F.lit("99999")).otherwise(digits)
    return [F.length(number), number, name]


def _pieces(text: Column) -> Column:
    """Text cut at asset references; references are pieces of their own."""
    return F.regexp_extract_all(text, F.lit(r'(?s)(!\[\]\([^)]+\)|src="[^"]+"|(?:(?!!\[\]\([^)]+\)|src="[^"]+").)+)'), F.lit(1))


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def _rewrite(documents: DataFrame, mapping: DataFrame, images_only: bool, new_piece, default=None) -> DataFrame:
    """Replace references by what the mapping (key, value) gives for their file name, or ``default(key)``.
    Only references travel: they join the mapping by name and come back as one small map per document."""
    cut = documents.withColumn("__p", _pieces(F.col("markdown")))
    pattern = r"^!\[\]\((.+)\)\z" if images_only else r'^(?:!\[\]\(|src=")(.+?)[)"]\z'
    refs = cut.select("doc_id", F.posexplode("__p").alias("pos", "piece"))
    refs = refs.withColumn("path", F.regexp_extract("piece", pattern, 1)).where("path <> ''").withColumn("key", _base_name(F.col("path")))
    matched = refs.join(mapping.select("key", "value"), "key", "inner" if default is None else "left")
    if default is not None:
        matched = matched.withColumn("value", F.coalesce("value", default(F.col("key"))))
    found = matched.select("doc_id", "pos", new_piece(F.col("piece"), F.col("path"), F.col("value")).alias("new"))
    maps = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("__m"))
    joined = cut.join(maps, "doc_id", "left")
    rebuilt = F.array_join(F.transform("__p", lambda x, i: F.coalesce(F.element_at("__m", i), x)), "")
    return joined.withColumn("markdown", F.when(F.col("__m").isNull(), F.col("markdown")).otherwise(rebuilt)).drop("__p", "__m")


def rewrite_paths(documents: DataFrame, mapping: DataFrame, folder: str = "") -> DataFrame:
    """``![](old)`` and ``src="old"`` with the new name (mapping old_name, new_name) in ``folder``; names the
    mapping lacks stay but move to ``folder`` too."""
    prefix = f"{folder}/" if folder else ""
    names = mapping.select(F.col("old_name").alias("key"), F.concat(F.lit(prefix), "new_name").alias("value"))
    return _rewrite(documents, names, False, lambda piece, path, value: F.replace(piece, path, value), lambda key: F.concat(F.lit(prefix), key))


def inject_descriptions(documents: DataFrame, descriptions: DataFrame) -> DataFrame:
    """A quoted description (name, description) after each picture of that file name."""
    told = descriptions.where(F.trim("description") != "").select(F.col("name").alias("key"), block_quote(F.trim("description")).alias("value"))
    return _rewrite(
        documents, told, True, lambda piece, path, value: F.concat(piece, F.lit(f"\n\n{DESCRIPTION_HEADING}\n"), value)
    )


_DATA_URI = r'src="(data:image/[^"]+)"'


def extract_inline_images(markup: DataFrame, text: str = "markup") -> tuple[DataFrame, DataFrame]:
    """Base64 pictures in markup out into assets (name, bytes; each once); ``src`` becomes the asset's name,
    the sha256 of the data URI plus its format."""
    def name(uri: Column) -> Column:
        fmt = F.lower(F.regexp_extract(uri, r"^data:image/([A-Za-z0-9.+-]+);base64,", 1))
        ext = F.when(fmt == "jpeg", "jpg").when(fmt == "svg+xml", "svg").otherwise(fmt)
        return F.concat(F.sha2(uri, 256), F.lit("."), ext)

    valid = r'(?s)(src="data:image/[A-Za-z0-9.+-]+;base64,[^"]+"|(?:(?!src="data:image/[A-Za-z0-9.+-]+;base64,[^"]+").)+)'
    pieces = F.regexp_extract_all(F.col(text), F.lit(valid), F.lit(1))
    uri = F.explode(F.regexp_extract_all(F.col(text), F.lit(r'(?s)src="(data:image/[A-Za-z0-9.+-]+;base64,[^"]+)"'), F.lit(1)))
    found = markup.select(uri.alias("uri"))
    assets = found.groupBy(name(F.col("uri")).alias("name")).agg(
        F.any_value(F.unbase64(F.regexp_extract("uri", r"(?s)base64,(.*)$", 1))).alias("bytes")
    )
    replaced = F.transform(
        pieces, lambda p: F.when(p.startswith('src="data:image/'), F.concat(F.lit('src="'), name(F.regexp_extract(p, _DATA_URI, 1)), F.lit('"'))).otherwise(p)
    )
    return markup.withColumn(text, F.array_join(replaced, "")), assets
