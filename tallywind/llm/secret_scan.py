"""Secret scanning over an incremental blob ledger (operator 3).

Every version of a text is a blob, addressed by its SHA-256. The ledger is a table of (blob, rule version) pairs
that have been scanned, with their findings. A run scans one copy of each blob whose pair isn't in the ledger,
adds those pairs, and joins the ledger's findings back to every row that holds the blob. Copies meet each other
in an aggregate that combines them before its shuffle; the join back is an equi-join of narrow rows.

A private key's span goes to its END line, or to the text's end where there is none, so that masking leaves nothing of its body.

Defined results: a null text is the empty blob; a row without findings has empty spans; repeated rows each get
their findings; an empty table gives no rows; other columns aren't read. Whole texts are scanned. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.llm.common import free_name, give_back, new_folder

RULES = "1.1"
BASE = ("assign", "access", "hex")

# The base rules, and the published shapes of some services' keys. ASCII: letters in either case are A-Z and a-z.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MORE = {
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:.*?-----END [A-Z ]{0,40}PRIVATE KEY-----|.*)", re.DOTALL)),
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "google": ("AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
}
ORDER = {k: i for i, k in enumerate((*BASE, *MORE))}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind as listed."""
    found, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]  # a run's first 24 match or no part of it does
    for kind, (sign, rule) in MORE.items():
        if sign in text:
            found += [(*m.span(), kind) for m in rule.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [scan(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array([[f"{k}:{s}:{e}" for s, e, k in x] for x in spans], pa.list_(pa.string()))], ["blob", "spans"])


def scan_documents(docs: DataFrame, ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """(doc_id, blob, spans) for every row of docs(doc_id, text).

    ledger: a folder that keeps (blob, rules, spans) between runs; None takes one that lasts for the session.
    Each run appends the pairs it scanned and reads all of them back.
    """
    spark = docs.sparkSession
    path = ledger or new_folder(spark, "ledger")
    schema = "blob binary, rules string, spans array<string>"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = docs.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    if ledger and _exists(spark, path):
        blobs = blobs.join(spark.read.schema(schema).parquet(path).where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    unseen.mapInArrow(_scan, "blob binary, spans array<string>").select("blob", F.lit(rules).alias("rules"), "spans").write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).where(F.col("rules") == rules)
    found = known.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))  # two runs at once may both add a pair
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<string>")).alias("spans"))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def mask_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """docs with every found span's characters replaced: the rows stay, the secrets go. Any other columns, whatever their
    names, stay as they are."""
    blob, found = free_name(docs.columns, "blob"), free_name(docs.columns, "spans")
    spans = scan_documents(docs.select("doc_id", "text"), ledger).where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans")).toDF(blob, found)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumn(blob, F.unhex(F.sha2(text, 256))).join(spans, blob, "left")
    return joined.mapInArrow(_mask(docs.columns, found), docs.schema)


def _mask(columns: list[str], found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), b.column(found).to_pylist(), strict=True):
                if spans:
                    out, at = [], 0
                    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans):
                        if e > at:
                            out += [text[at : max(at, s)], "[SECRET]" if s >= at else ""]
                            at = e
                    text = "".join(out) + text[at:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in columns], columns)
        give_back()

    return run
