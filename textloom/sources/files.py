"""Reading and writing corpora, indexes, term tables, runs and text files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from textloom import schemas
from textloom.functions import text as tx
from textloom.operators import evals
from textloom.operators.numbering import running_offsets
from textloom.operators.skew import broadcast_if_small
from textloom.sources.splitscan import read_json_records


def read_corpus_json(spark: SparkSession, path: str, schema: str = schemas.CHUNK, lines: bool = False) -> DataFrame:
    """Corpus JSON: a list of records, or ``{"data": [...]}``.

    A file that is one JSON document (``lines=False``) is read in byte ranges by many tasks; with
    ``lines=True`` every line is a record or a wrapped list.
    """
    if not lines:
        return read_json_records(spark, path).select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    wrapped = f"{schema}, data array<struct<{_colon(schema)}>>, _corrupt_record string"
    rows = spark.read.schema(wrapped).json(path, mode="PERMISSIVE")
    names = StructType.fromDDL(schema).fieldNames()
    own = F.struct(*names)
    found = F.when(F.col("data").isNotNull(), F.col("data")).when(
        F.col("_corrupt_record").isNull() & F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull(), F.array(own)
    )
    # Anything that is neither form is an error, not an empty corpus.
    checked = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("neither a list of records nor a data list")))
    return rows.select(F.explode(checked).alias("r")).select("r.*")


def _colon(schema: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def write_corpus_json(df: DataFrame, path: str) -> None:
    """The eleven corpus fields, one record per line."""
    df.select(*schemas.CHUNK_FIELDS).write.json(path)


def read_embedding_index(spark: SparkSession, path: str) -> DataFrame:
    """Parquet index with a normalised ``text_id``, a text and vectors as arrays of doubles."""
    df = spark.read.parquet(path)
    if "text_id" in df.columns:
        df = df.withColumn("text_id", tx.id_label(F.col("text_id")))
    elif "combined" in df.columns:
        df = df.withColumn("text_id", F.nullif(F.regexp_extract("combined", r"(Text #: \d+)", 1), F.lit("")))
    else:
        df = _numbered_rows(df)
    if "full_text" not in df.columns:
        body = tx.body_between(F.col("combined")) if "combined" in df.columns else F.lit("")
        df = df.withColumn("full_text", body)
    df = df.withColumn("full_text", F.coalesce(F.col("full_text").cast("string"), F.lit("")))
    if "embedding" in df.columns:
        kind = df.schema["embedding"].dataType.simpleString()
        vec = tx.parse_vector(F.col("embedding")) if kind == "string" else F.coalesce(
            F.col("embedding").cast("array<double>"), F.array().cast("array<double>")
        )
        df = df.withColumn("embedding", vec)
    return df


def _numbered_rows(df: DataFrame) -> DataFrame:
    """``text_id`` from the place of a row: file name, then row number within the file."""
    at = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    sizes = at.groupBy("_file").agg(F.count("*").alias("_n"))
    # One row per file; ranked by name, then summed up in blocks.
    ranked = sizes.select("_file", "_n", (F.rank().over(_by("_file")) - 1).cast("long").alias("_k"))
    offsets = ranked.join(running_offsets(ranked.select("_k", "_n"), "_k", "_n"), "_k").select("_file", "offset")
    numbered = at.join(offsets, "_file").withColumn(
        "text_id", F.concat(F.lit("Text #: "), F.col("offset") + F.col("_row"))
    )
    return numbered.drop("_file", "_row", "offset")


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.orderBy(*cols)


def read_term_table(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """``term, raw_freq, doc_freq`` from ``{"corpusTerms": {...}}``, an object or a JSON string of it.

    One document per line, or with ``lines=False`` one per file. What is neither raises an error.
    """
    raw = spark.read.text(path, wholetext=not lines).filter(tx.strip(F.col("value")) != "")
    terms = F.from_json(F.get_json_object("value", "$.corpusTerms"), schemas.TERM_DOC, {"mode": "FAILFAST"})["terms"]
    broken = F.raise_error(F.concat(F.lit("no term table: "), F.left("value", F.lit(80))))
    rows = raw.select(F.inline(F.when(terms.isNull(), broken).otherwise(terms)))
    return rows.select(
        "term", F.col("rawFreq").alias("raw_freq"), F.col("inDocumentsCount").alias("doc_freq")
    )


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.TRAINING_EXAMPLE) -> DataFrame:
    """One JSON record per non-blank line; a broken line raises an error."""
    lines = spark.read.text(path).filter(tx.strip(F.col("value")) != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON record per line, without the ``_meta`` column."""
    df.drop("_meta").write.json(path)


def read_runs(spark: SparkSession, paths: list[str], schema: str = schemas.RUN) -> tuple[DataFrame | None, list[str]]:
    """Union of run files tagged with their index, and the errors of those that are missing."""
    runs, errors = None, []
    for i, path in enumerate(paths):
        try:
            df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
        except AnalysisException as e:
            errors.append(f"{path}: {e.getCondition()}")
            continue
        part = evals.normalize_run(df, i)
        runs = part if runs is None else runs.unionByName(part, allowMissingColumns=True)
    return runs, errors


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    flat = [
        F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*flat).write.csv(path, header=True, quoteAll=True, escape='"')


def read_texts(spark: SparkSession, paths: str | list[str], manifest: DataFrame) -> DataFrame:
    """Whole text files with the labels of ``manifest(file_name, position, label)``.

    Labels follow the manifest, never the sort order of file names. Bytes that are not UTF-8
    become replacement characters.
    """
    files = spark.read.format("binaryFile").load(paths).select(
        F.element_at(F.split(F.col("path"), "/"), -1).alias("file_name"), "content"
    )
    return broadcast_if_small(manifest).join(files, "file_name", "left").select(
        "position", "label", "file_name", F.make_valid_utf8(F.col("content").cast("string")).alias("full_text")
    )


def read_sectioned(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of ``text_id:``, ``source:``, ``full_text:``, ``summary:`` and ``keywords:`` blocks."""
    raw = spark.read.text(paths, wholetext=True)
    return parse_sections(raw, "value")


def parse_sections(rows: DataFrame, value: str) -> DataFrame:
    names = ["text_id", "source", "full_text", "summary", "keywords"]

    def block(i: int):
        until = rf"(?=\n+{names[i + 1]}:)" if i + 1 < len(names) else r"\z"
        return tx.strip(F.regexp_extract(value, rf"(?s)(?:\A|\n){names[i]}:(.*?){until}", 1))

    def after(c, tag: str):
        return tx.strip(F.regexp_replace(c, rf"^{tag}:", ""))

    text = F.regexp_replace(block(2), r'^"|"$', "")
    return rows.select(
        block(0).alias("text_id"), after(block(1), "Source").alias("source"),
        F.replace(text, F.lit("\\n"), F.lit("\n")).alias("full_text"), after(block(3), "Summary").alias("summary"),
        tx.keyword_list(after(block(4), "Keywords")).alias("keywords"),
    )


def passage_map(docs: DataFrame, value: str) -> DataFrame:
    """``passage_id, doc_id`` from JSON objects ``{"0": "Text #: 0", ...}``."""
    pairs = docs.select(F.explode(F.from_json(value, schemas.PASSAGE_MAP)).alias("p", "doc_id"))
    return pairs.select(F.col("p").cast("long").alias("passage_id"), "doc_id")


def passage_lengths(docs: DataFrame, value: str) -> DataFrame:
    """``passage_id, n_tokens`` from a JSON array of lengths."""
    items = docs.select(F.posexplode(F.from_json(value, "array<bigint>")).alias("p", "n_tokens"))
    return items.select(F.col("p").cast("long").alias("passage_id"), "n_tokens")
