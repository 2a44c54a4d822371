"""Lines that many documents share, found by levelled sorted runs of line hashes.

A run is a table of (h, g, n): the 128-bit hash of a line's key and the number of documents it was met
in, in buckets of the hash and sorted inside each. Documents come in batches. A batch

1. counts its own keys (partial counts first, so a frequent line is one row per task),
2. merge-anti-joins every run for the keys that are settled there (found in enough documents already),
   bucket by bucket, without moving a run, and
3. writes the rest as a run of level 0.

When a level holds `fanout` runs, they are merged into one run of the next level, where partial counts
of a key add up, and the merged ones are deleted. So a key is rewritten once per level, and the number
of runs grows with the logarithm of the number of batches. The runs outlive the job: `save` writes their
list and `LineRuns.load` goes on from it.

Dropping: the frequent keys go to the documents' lines by a broadcast of the LISTED most frequent ones,
and, if there are more, by a merge join of the lines that these leave, in which no key can hold a large
share. What is dropped goes to each document as a list of positions.

Defined results: a line's key is the line without ASCII white space at both ends, A-Z in lower case; a
null or empty text is one empty line; a key counts once per row, however often its text repeats it, and
each row is a document (repeated rows, repeated and null ids too); keys shorter than min_chars code
points are never dropped; exactly min_docs documents are enough; texts are read whole, a very long one
in one row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, materialize, read_table, remove, shared_dir, text_or_empty

#: Batches of one call, runs of a level that are merged, and frequent keys that are broadcast at most.
BATCHES, FANOUT, LISTED = 6, 3, 1 << 16
#: Documents and code points that make a key one to drop.
MIN_DOCS, MIN_CHARS = 10, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda line: F.btrim(line, F.lit(SPACES)))


def _hashes(key: str) -> list[Column]:
    """Two independent halves of a 128-bit hash."""
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


def document_keys(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g), one row per document and key."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(text_or_empty(text_col)))).alias("key"))
    return keys.where(F.char_length("key") >= max(1, min_chars)).select(*_hashes("key"))


class LineRuns:
    """The runs of an index, by level; all lie in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, folder: str | None = None, buckets: int | None = None):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs must be 1 or more, fanout 2 or more")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = folder or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _path(self, run: str) -> str:
        return f"{self.folder}/{run}"

    def _write(self, rows: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", self._path(run)).option("compression", "zstd").format("parquet").saveAsTable(run)
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, self._path(run))

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _counts(self, runs: list[str]) -> DataFrame:
        """Runs merged: read as plain files, since a union of bucketed tables takes them as partitioned alike."""
        every = self.spark.read.schema("h long, g long, n long").parquet(*map(self._path, runs))
        return every.groupBy("h", "g").agg(F.sum("n").alias("n"))

    def add(self, keys: DataFrame) -> None:
        """Takes in a batch: (h, g), one row per document and key."""
        new = keys.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            settled = self.spark.table(run).where(F.col("n") >= self.min_docs).select("h", "g")
            new = new.join(settled.hint("merge"), ["h", "g"], "left_anti")
        self.levels[0].append(self._write(new))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._counts(old)))
            for run in old:
                self._drop(run)
            level += 1

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those of the keys (h, g) that no run holds, by one merge anti join with each."""
        for run in self.runs():
            keys = keys.join(self.spark.table(run).select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        return keys

    def frequent(self) -> DataFrame:
        """(h, g, n) of the keys found in min_docs documents or more; n stops growing once a key is settled."""
        if not self.runs():
            return self.spark.createDataFrame([], "h long, g long, n long")
        return self._counts(self.runs()).where(F.col("n") >= self.min_docs)

    def save(self) -> str:
        """Writes the list of runs, and returns the folder that `load` takes."""
        rows = [(level, run, self.min_docs, self.fanout, self.buckets) for level, runs in enumerate(self.levels) for run in runs]
        self.spark.createDataFrame(rows, "level int, run string, min_docs int, fanout int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list")
        return self.folder

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LineRuns:
        rows = spark.read.parquet(f"{folder}/list").collect()
        if not rows:
            return cls(spark, folder=folder)
        out = cls(spark, rows[0].min_docs, rows[0].fanout, folder, rows[0].buckets)
        out.levels = [[] for _ in range(1 + max(r.level for r in rows))]
        for r in rows:
            out.levels[r.level].append(r.run)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r.run} (h LONG, g LONG, n LONG) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {r.buckets} BUCKETS LOCATION '{folder}/{r.run}'")
        return out

    def delete(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = [[]]


def index_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> LineRuns:
    """Runs of all documents, taken in by batches of their ids' hashes."""
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for k in range(batches):
        runs.add(document_keys(docs.where(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(batches)) == k), text_col, min_chars))
    return runs


def _lines_to_drop(lines: DataFrame, frequent: DataFrame, listed: int) -> DataFrame:
    """Rows of lines (row, pos, h, g) whose key is frequent."""
    keys = frequent.select("h", "g", "n")
    if keys.limit(listed + 1).count() <= listed:
        return lines.join(F.broadcast(keys.drop("n")), ["h", "g"], "left_semi")
    top = materialize(keys.orderBy(F.desc("n"), "h", "g").limit(listed).drop("n"), "listed-lines")
    rest = keys.drop("n").join(F.broadcast(top), ["h", "g"], "left_anti")
    others = lines.join(F.broadcast(top), ["h", "g"], "left_anti")
    return lines.join(F.broadcast(top), ["h", "g"], "left_semi").unionByName(others.join(rest.hint("merge"), ["h", "g"], "left_semi"))


def drop_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, listed: int = LISTED) -> DataFrame:
    """Documents without the lines whose key (h, g) is in frequent: doc_id, n_lines, n_dropped, kept_text."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = base.select("row", F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).where(F.char_length("key") >= max(1, min_chars)).select("row", "pos", *_hashes("key"))
    gone = _lines_to_drop(lines, frequent, listed).groupBy("row").agg(F.collect_set("pos").alias("gone"))
    met = base.join(gone, "row", "left")

    def without(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda k: F.get(lines, k)), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n")), without)[0])
    return met.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Documents without the lines that min_docs or more of them share: doc_id, n_lines, n_dropped, kept_text."""
    runs = index_lines(docs, id_col, text_col, min_docs, min_chars, batches, fanout)
    frequent = materialize(runs.frequent(), "frequent-lines")
    runs.delete()
    return drop_lines(docs, frequent, id_col, text_col, min_chars)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, r, i, line, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, r, unnest(s) AS line, unnest(range(len(s))) AS i
        FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY r
"""
