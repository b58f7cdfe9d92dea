"""Frequency of every distinct term, by heavy-light aggregation.

A few terms hold most rows, so shuffling by term alone sends them to single tasks. Here the terms
above a share of all rows are found first (a Misra-Gries pass over hashes of the terms, so that a term of any
length counts: no heavy term is missed, at most 1/share hashes are returned), their hashes are broadcast, and
they are counted in exact arrays inside each partition. Only the remaining terms, each below that share, are
shuffled by term. Both tables are then united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions.text import collapse_blanks
from sondera.session import store


def normalised_term(c):
    """Blanks collapsed, lower case; blank and null texts give null."""
    t = F.lower(collapse_blanks(c))
    return F.when(t != "", t)


def heavy_terms(terms: DataFrame, share: float) -> list[int]:
    """Hashes of every term above ``share`` of the rows, and perhaps of some below."""
    found = terms.where("term is not null").select(F.xxhash64("term").alias("h")).freqItems(["h"], share).first()
    return sorted((found and found[0]) or [])


def _heavy_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, term, file, n): a row for each term and file of a batch, and one with the term and its total for the partition.

    Terms of equal hash are kept apart: counters belong to terms, which meet by a 128-bit digest.
    """
    place: dict[str, int] = {}
    digests: list[bytes] = []
    totals = np.zeros(0, np.int64)
    kind = [pa.binary(), pa.string(), pa.string(), pa.int64()]
    names = ["digest", "term", "file", "n"]
    for batch in batches:
        coded = batch["term"].dictionary_encode()
        for t in coded.dictionary.to_pylist():
            if t not in place:
                place[t] = len(digests)
                digests.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        at = np.array([place[t] for t in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
        totals = np.r_[totals, np.zeros(len(digests) - len(totals), np.int64)]
        np.add.at(totals, at, np.asarray(batch["n"]))
        pairs = pa.table({"at": pa.array(at), "file": batch["file"]}).group_by(["at", "file"]).aggregate([])
        pairs = pairs.filter(pc.is_valid(pairs["file"]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([digests[i] for i in pairs["at"].to_pylist()], kind[0]), pa.nulls(len(pairs), kind[1]), pairs["file"].combine_chunks(), pa.array(np.zeros(len(pairs), np.int64))], names
        )
    # A term whose rows all lack a file and a count still has its row.
    yield pa.RecordBatch.from_arrays([pa.array(digests, kind[0]), pa.array(list(place), kind[1]), pa.nulls(len(place), kind[2]), pa.array(totals)], names)


def term_frequencies(rows: DataFrame, *, share: float = 0.001) -> DataFrame:
    """(term, total, files) of rows (term, file, n): the sum of n and the number of distinct non-null files.

    Null terms are dropped; a term of null files only has files = 0; an empty table gives none.
    Extra columns are ignored. Null or negative n count as 0. Rows are taken as they are: remove
    repeated deliveries before. Exact for every term, heavy or not, whatever its length.
    """
    slim = rows.select(F.col("term").cast("string").alias("term"), F.col("file").cast("string").alias("file"), F.greatest(F.coalesce(F.col("n").cast("long"), F.lit(0)), F.lit(0)).alias("n")).where("term is not null")
    heavy = heavy_terms(slim, share)
    is_heavy = F.xxhash64("term").isin(heavy) if heavy else F.lit(False)
    light = slim.where(~is_heavy)
    # Counted in place first; what is left of a term is below the share of all rows.
    light = light.groupBy("term", "file").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("total"), F.count("file").alias("files"))
    if not heavy:
        return light
    counted = slim.where(is_heavy).mapInArrow(_heavy_counters, "digest binary, term string, file string, n long")
    dense = counted.groupBy("digest", "file").agg(F.sum("n").alias("n"), F.max("term").alias("term")).groupBy("digest").agg(F.max("term").alias("term"), F.sum("n").alias("total"), F.count("file").alias("files"))
    return light.unionByName(dense.select("term", "total", "files"))


def latest_candidates(candidates: DataFrame) -> DataFrame:
    """(cand_id, term, file, n): the row delivered last of each cand_id; equal times fall to the greater content."""
    slim = candidates.select("cand_id", normalised_term(F.col("text")).alias("term"), F.col("file_id").alias("file"), F.col("occurrences").alias("n"), "loaded_at")
    order = Window.partitionBy("cand_id").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("term"), F.desc_nulls_last("file"), F.desc_nulls_last("n"))
    return slim.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "loaded_at")


def marked_terms(rows: DataFrame, *, share: float = 0.001, min_total: int = 5, min_files: int = 2, common_share: float = 0.5) -> DataFrame:
    """(term, total, files, mark): mark 'rare' below min_total or min_files, 'common' above common_share of all files, else null."""
    rows = store(rows)
    counted = term_frequencies(rows, share=share)
    n_files = rows.select(F.countDistinct("file").alias("n_files"))
    mark = F.when((F.col("total") < min_total) | (F.col("files") < min_files), "rare").when(F.col("files") > F.col("n_files") * F.lit(common_share), "common")
    # One row, one number: a scalar beside each row, no join of collections.
    return counted.join(F.broadcast(n_files)).select("term", "total", "files", mark.alias("mark"))
