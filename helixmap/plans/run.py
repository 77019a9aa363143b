"""One call from files to text: what a command line asks for, run on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmap.operators.index import Index, build_index, read_index
from helixmap.operators.mapping import described, map_queries
from helixmap.plans.params import Command, MapParams, parse_command
from helixmap.sinks import formats
from helixmap.sources.seqfile import read_sequences


def _is_index(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return "," not in path and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def references(spark: SparkSession, path: str, params: MapParams) -> DataFrame:
    """rid, name and seq of reference files; ids rise with files and records, from ``base_rid`` on."""
    rows = read_sequences(spark, path, min_len=params.min_len, keep_qual=False)
    return rows.select((F.col("ordinal") + params.base_rid).alias("rid"), "name", "seq")


def reads(spark: SparkSession, path: str, params: MapParams) -> DataFrame:
    """qid, name, seq, qual and tags of query files; ids rise with files and records, from ``base_qid`` on."""
    rows = read_sequences(spark, path, min_len=params.min_len, keep_qual=params.keep_qual, tags=params.tags)
    return rows.select((F.col("ordinal") + params.base_qid).alias("qid"), "name", "seq", "qual", "tags")


def index_of(spark: SparkSession, path: str, params: MapParams) -> Index:
    """A written index, or one built from files."""
    return read_index(spark, path, params) if _is_index(spark, path) else build_index(references(spark, path, params), params)


def run(spark: SparkSession, command: str | Command, out: str = "") -> DataFrame | None:
    """Runs a command line (without the program's name) and gives the alignments; text goes to the folder ``out``.

    The first file is the reference, or a written index; the others are queries. Option d writes the index, of all
    files, and maps nothing. With option X and one file, its records are mapped onto each other.
    """
    asked = parse_command(command) if isinstance(command, str) else command
    params, files = asked.params, asked.files
    if not files:
        raise ValueError("no reference is named")
    if asked.index_path:
        build_index(references(spark, ",".join(files), params), params).write(asked.index_path)
        return None
    if len(files) < 2 and not params.all_vs_all:
        raise ValueError("no queries are named")
    index = index_of(spark, files[0], params)
    queries = reads(spark, ",".join(files[1:] or files), params)
    rows = described(map_queries(queries, index, params), queries, index)
    if out:
        header = formats.sam_header(index.refs, params) if params.format == "sam" else None
        formats.write_lines(formats.lines_of(rows, params, queries), out, header)
    return rows
