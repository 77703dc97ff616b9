"""URL filters (operator 7): a sorted array of 64-bit digests of host+path rules.

Rule keys (host, "/" and path prefix) are digested with xxhash and sorted into one
file, which Spark ships to the executors (addFile) and each worker memory-maps.
A url yields one probe for every host suffix and every path prefix whose length
some rule has; all probes of a batch meet the array in one vectorised binary
search, and a hit counts only if the stored string equals the probe.

Cases: a null url, or one without ``://``, has empty host and path and no rule.
Equal digests of different strings are told apart by the strings. Repeated rules:
the first stays. Rows are independent.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmatch.llm.common import lower_ascii, pick, write_bytes

#: (verdict, rule as host + path)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def write_index(spark: SparkSession, rules) -> str:
    """Write the digest file to the shared folder and ship it; the name under which workers find it."""
    rows = {}
    for verdict, rule in rules:
        rows.setdefault(rule, verdict)
    keyed = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in rows.items())
    blob = "\0".join(f"{r}\t{v}" for _, r, v in keyed).encode()
    ends = np.cumsum([0] + [len(f"{r}\t{v}".encode()) + 1 for _, r, v in keyed]).astype("<u8")
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    keys = np.array([k for k, _, _ in keyed], "<u8")
    lengths = np.array(sorted({len(r.partition("/")[2]) + 1 for r in rows}), "<u8")  # of "/" + path
    head = np.array([len(keyed), len(lengths)], "<u8")
    path = write_bytes(spark, name, b"".join(x.tobytes() for x in (head, keys, ends, lengths)) + blob)
    spark.sparkContext.addFile(path)
    return name


class DigestIndex:
    """The memory-mapped file: counts, sorted digests, string offsets, the lengths of the rules' paths, strings."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view("<u8"))
        numbers = raw[16 : 16 + 8 * (2 * n + 1 + m)].view("<u8")
        self.keys, self.ends, self.lengths = numbers[:n], numbers[n : 2 * n + 1], numbers[2 * n + 1 :].tolist()
        self.text = raw[16 + numbers.nbytes :]

    def entry(self, i: int) -> tuple[str, str]:
        rule, _, verdict = bytes(self.text[int(self.ends[i]) : int(self.ends[i + 1]) - 1]).decode().rpartition("\t")
        return rule, verdict

    def probe(self, candidates: list[str]) -> list[tuple[str, str] | None]:
        """Rule and verdict of each candidate string, None where it is no rule."""
        digests = np.array([xxhash.xxh64_intdigest(c) for c in candidates], "<u8")
        first = np.searchsorted(self.keys, digests, "left")
        last = np.searchsorted(self.keys, digests, "right")
        out: list[tuple[str, str] | None] = [None] * len(candidates)
        for i in np.flatnonzero(last > first):
            out[i] = next((e for k in range(first[i], last[i]) if (e := self.entry(k))[0] == candidates[i]), None)
        return out


def candidates_of(host: str, path: str, lengths: list[int]) -> list[str]:
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [h + path[:n] for h in hosts for n in lengths if n <= len(path)]


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, the longest rule that fits (null if none) and its verdict, else the default."""
    spark = pages.sparkSession
    name = write_index(spark, rules)
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    parts = (
        pick(pages, "page_id", "url")
        .withColumn("rest", rest)
        .select(
            "page_id",
            lower_ascii(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"),
            F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )

    def run(batches):
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            owner, flat = [], []
            for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = candidates_of(host, path, index.lengths)
                owner += [i] * len(found)
                flat += found
            best: list[tuple[str, str] | None] = [None] * batch.num_rows
            for i, hit in zip(owner, index.probe(flat)):
                if hit and (best[i] is None or len(hit[0]) > len(best[i][0])):
                    best[i] = hit
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([b and b[0] for b in best], pa.string()),
                    pa.array([b[1] if b else default for b in best], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


#: The same in SQL, with the fixed rules written out.
ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT a.page_id, a.host, a.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY a.page_id, a.host, a.path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM parts a LEFT JOIN rules r ON (a.host = r.h OR ends_with(a.host, '.' || r.h)) AND starts_with(a.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
