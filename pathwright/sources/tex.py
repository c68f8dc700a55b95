"""TeX archives: files of a source, the main file, inlined inputs, bibliographies."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import gzip
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_INPUT = re.compile(r"\\(?:input|include)\{([^}]+)\}")


def read_archives(spark: SparkSession, path: str, least: int = 1024) -> DataFrame:
    """(paper_id, path, text) of the text files in source archives `<paper_id>.tar.gz`, `.tar` or `.gz`; shorter archives count as failed
    downloads. Members that lead outside their archive, and links, are left out; nothing is written to disk."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(content) < least:
                    continue
                paper = re.sub(r"(?:\.tar)?(?:\.t?gz)?$", "", posixpath.basename(name))
                for member, data in _members(content):
                    for column, value in zip(out, (paper, member, data.decode("utf-8", "replace"))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["paper_id", "path", "text"])

    return files.mapInArrow(run, "paper_id string, path string, text string")


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for m in tar:
                path = posixpath.normpath(m.name)
                if m.isfile() and not path.startswith(("/", "..")) and path.lower().endswith((".tex", ".bib", ".bbl")):
                    yield path, tar.extractfile(m).read()
    except tarfile.TarError:
        try:
            yield "main.tex", gzip.decompress(content)
        except OSError:
            return


def main_files(files: DataFrame, recursive: bool = False, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, path): the main TeX file of each source. Of the top folder: the one named like a .bbl file, else the first that begins a document,
    else the first; recursive: the one of the highest score, 3 for a document, 2 for a class, 1 per 1,000 characters. First is by path."""
    tex = files.where(F.lower("path").endswith(".tex"))
    begins = F.contains("text", F.lit("\\begin{document}"))
    if recursive:
        score = F.when(begins, 3).otherwise(0) + F.when(F.contains("text", F.lit("\\documentclass")), 2).otherwise(0) + F.floor(F.length("text") / 1000)
        w = Window.partitionBy(*key).orderBy(F.desc(score), "path")
        return tex.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, "path")
    tex = tex.where(~F.contains("path", F.lit("/")))
    stems = files.where(F.col("path").endswith(".bbl") & ~F.contains("path", F.lit("/"))).groupBy(*key).agg(F.min("path").alias("_bbl"))
    j = tex.join(stems, list(key), "left")
    named = F.coalesce(F.regexp_replace("path", r"\.tex$", "") == F.regexp_replace("_bbl", r"\.bbl$", ""), F.lit(False))
    w = Window.partitionBy(*key).orderBy(F.when(named, 0).when(begins, 1).otherwise(2), "path")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, "path")


def inlined(main: str, files: dict[str, str]) -> str:
    """A file's text with its inputs in place, each file once in all; what is absent or comes again leaves a comment. Runs over a stack, so that
    deep chains of inputs need no recursion."""
    seen: set[str] = set()
    out: list[str] = []
    stack = [(posixpath.dirname(main), files.get(main, ""), 0)]
    while stack:
        folder, text, at = stack.pop()
        m = _INPUT.search(text, at)
        if not m:
            out.append(text[at:])
            continue
        out.append(text[at : m.start()])
        stack.append((folder, text, m.end()))
        name = m[1] if m[1].endswith(".tex") else m[1] + ".tex"
        full = posixpath.normpath(posixpath.join(folder, name))
        if full in seen:
            out.append(f"% input again: {full}\n")
        elif full not in files:
            out.append(f"% no such file: {full}\n")
        else:
            seen.add(full)
            stack.append((posixpath.dirname(full), files[full], 0))
    return "".join(out)


def processed_texts(files: DataFrame, mains: DataFrame) -> DataFrame:
    """(paper_id, text): the main file of each source with its inputs in place. One row holds one source's TeX files."""
    m = F.pandas_udf(_inline_batch, "string")
    tex = files.where(F.lower("path").endswith(".tex")).groupBy("paper_id").agg(F.collect_list("path").alias("_p"), F.collect_list("text").alias("_t"))
    j = mains.join(tex, "paper_id")
    return j.select("paper_id", m("path", "_p", "_t").alias("text"))


def _inline_batch(main: pd.Series, paths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([inlined(m, dict(zip(p, t))) for m, p, t in zip(main, paths, texts)])


def bibliographies(files: DataFrame) -> DataFrame:
    """(paper_id, bib_texts map of path to text, bibliography) of each source's .bib files by path."""
    b = files.where(F.lower("path").endswith(".bib")).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("_b"))
    return b.select("paper_id", F.map_from_entries("_b").alias("bib_texts"), F.array_join(F.transform("_b", lambda x: x["text"]), "\n\n").alias("bibliography"))


def related_work(sections: DataFrame, full_texts: DataFrame) -> DataFrame:
    """(paper_id, text): the first section file by name with `related` in it, else that section of the whole text.
    sections: (paper_id, name, text); full_texts: (paper_id, text)."""
    from pathwright.functions.latex import best_section

    s = sections.where(F.contains(F.lower("name"), F.lit("related"))).groupBy("paper_id").agg(F.min_by("text", "name").alias("_s"))
    j = full_texts.join(s, "paper_id", "full")
    return j.select("paper_id", F.coalesce("_s", best_section(F.col("text"), "related")).alias("text")).where("text is not null")
