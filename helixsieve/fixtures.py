"""Reads derived from the table ``orders``, by SQL that Spark and DuckDB both run.

``orders`` has no reads; md5 digests of its key, translated to bases and qualities, make pairs of 128 bases, spiked
with copies, adapter read-through, poly-G tails, runs of N and short inserts.
"""

from __future__ import annotations

#: Public sequencing adapters, 32 bases of each.
ADAPTER1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTC"
ADAPTER2 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTG"


def _hex(key: str, tag: str, n: int = 4) -> str:
    return " || ".join(f"md5(CAST({key} AS STRING) || '|{tag}|{i}')" for i in range(n))


def _seq(mate: int) -> str:
    base = f"translate({_hex('k', str(mate))}, '0123456789abcdef', 'ACGTACGTACGTACGA')"
    adapter = ADAPTER1 if mate == 1 else ADAPTER2
    if mate == 1:
        return f"""CASE WHEN ord % 10 = 3 THEN substr({base}, 1, 96) || '{adapter}'
             WHEN ord % 17 = 5 THEN substr({base}, 1, 108) || repeat('G', 20)
             WHEN ord % 29 = 7 THEN repeat('N', 12) || substr({base}, 13)
             WHEN ord % 31 = 9 THEN substr({base}, 1, 24) ELSE {base} END"""
    return f"CASE WHEN ord % 10 = 3 AND ord % 3 > 0 THEN substr({base}, 1, 96) || '{adapter}' WHEN ord % 37 = 9 THEN substr({base}, 1, 28) ELSE {base} END"


def _qual(mate: int) -> str:
    return f"substr(translate({_hex('k', f'q{mate}')}, '0123456789abcdef', '#-27:<=>?@ABCDEF'), 1, length(seq{mate}))"


#: Columns ord, id1, seq1, qual1, id2, seq2, qual2.
READS = f"""
SELECT ord, id || '/1' AS id1, seq1, {_qual(1)} AS qual1, id || '/2' AS id2, seq2, {_qual(2)} AS qual2
FROM (SELECT ord, k, '@FCD1PB1ACXX:4:' || CAST(1101 + ord % 8 AS STRING) || ':' || CAST(ord AS STRING) || ':2201#GAAGCACG' AS id,
             {_seq(1)} AS seq1, {_seq(2)} AS seq2
      FROM (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey - o_orderkey % 46 ELSE o_orderkey END AS k FROM orders) o) r
"""

#: Barcodes of 10 bases, numbered, from the keys of ``part``.
BARCODES = "SELECT substr(translate(md5(CAST(p_partkey AS STRING) || '|barcode'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 10) AS barcode, CAST(p_partkey AS INT) AS barcode_id FROM part"
#: Barcoded pairs: read 2 has 142 bases, the segments at 101, 117 and 133; some have one wrong base, some are none.
BARCODED = f"""
SELECT r.ord, r.id1, r.seq1, r.qual1, r.id2,
       substr(r.seq2 || r.seq2, 1, 100) || CASE WHEN r.ord % 7 = 0 THEN 'T' || substr(a.barcode, 2) WHEN r.ord % 11 = 0 THEN 'NNNNNNNNNN' ELSE a.barcode END
         || 'ACGTCA' || b.barcode || 'GTCAGT' || c.barcode AS seq2,
       repeat('F', 142) AS qual2
FROM (SELECT r.*, n, lo FROM ({READS}) r CROSS JOIN (SELECT count(*) AS n, min(p_partkey) AS lo FROM part) p) r JOIN ({BARCODES}) a ON a.barcode_id = r.ord % n + lo JOIN ({BARCODES}) b ON b.barcode_id = (r.ord * 7) % n + lo JOIN ({BARCODES}) c ON c.barcode_id = (r.ord * 13) % n + lo
"""


#: Folders that hold the rows of some SQL already, for runs that measure what follows.
PREPARED: dict[str, str] = {}


#: Rows that a task derives reads from, where there are enough of them, and at most.
LEAST, MOST = 10_000, 100_000


def reads(spark, sf_dir: str, sql: str = READS):
    """The reads of a data folder."""
    if sql in PREPARED:
        return spark.read.parquet(PREPARED[sql])
    for name, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # A row becomes 600 bytes of reads: a row group of keys, which one task reads, would be a task's work many times over.
        n = df.count()
        tasks = max(min(spark.sparkContext.defaultParallelism, n // LEAST), n // MOST, 1)
        df.repartition(tasks, key).createOrReplaceTempView(name)
    return spark.sql(sql)


def prepare(spark, sf_dir: str, at: str, sqls: list[str], times: int) -> int:
    """Write the reads of some SQL below a folder, over ``times`` as many orders, and return how many pairs there are."""
    reads(spark, sf_dir)
    orders = spark.table("orders").select("o_orderkey")
    step = orders.agg({"o_orderkey": "max"}).first()[0] + 1
    more = orders.join(spark.range(times).withColumnRenamed("id", "again")).selectExpr(f"o_orderkey + {step} * again AS o_orderkey")
    more.createOrReplaceTempView("orders")
    for i, sql in enumerate(sqls):
        spark.sql(sql).repartition(16).write.parquet(f"{at}/{i}")
        PREPARED[sql] = f"{at}/{i}"
    return more.count()
