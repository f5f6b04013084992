"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Every run of 20 or more key characters is a candidate; one that fits no encoding, such as a token glued to a URL path, is
taken in pieces that do. The encoding (alphabet) is inferred; then chi-squared uniformity of
the alphabet, the runs of upper and lower half symbols, and the serial correlation of neighbours are tested against a random
string of that encoding and length, and combined by Fisher's method. Within each stratum of length, Benjamini-Hochberg
control over the whole corpus says which candidates are surely not random; the others are secrets. The control needs only
counts in bins of the combined statistic, so nothing is ranked row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named, text_or_empty

# Fixed values of the scan's contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(?:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}=*"
#: The pieces of a run that fits no encoding: what is between slashes and hyphens, if need be between _ or + as well; then,
#: where no such piece is long enough, a stretch of one of the two alphabets with all of its slashes or hyphens.
PIECE = "|".join(
    x.replace("20", str(MIN_RUN)) + "=*"
    for x in (
        "(?<![A-Za-z0-9+_])[A-Za-z0-9_]{20,}(?![A-Za-z0-9+_])",
        "(?<![A-Za-z0-9+])[A-Za-z0-9+]{20,}",
        "(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}",
        "(?<![A-Za-z0-9+/])(?![A-Za-z0-9+/]*[A-Za-z0-9+]{20})[A-Za-z0-9+/]{20,}",
        "(?<![A-Za-z0-9_-])(?![A-Za-z0-9_-]*[A-Za-z0-9_]{20})[A-Za-z0-9_-]{20,}",
    )
)
#: Encodings in the order in which they are tried, with their alphabets.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Rate of false discoveries among the candidates that a stratum calls not random.
FDR = 0.05
#: Width and number of the bins of -ln p.
BIN, BINS = 0.125, 400


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """An array of (gap, size, inner): code points before each match since the last one, in it, and in its group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit"), inner.alias("inner")), lambda x: x["hit"].isNotNull())


def _normal_tail(z: Column) -> Column:
    """P(Z > z) by the classical five-term approximation (error under 1e-7), never below 1e-20."""
    x = F.least(F.abs(z), F.lit(9.0))
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-20))


def _encoding(token: Column) -> Column:
    """The first encoding that fits the token without its padding, or null."""
    bare = F.regexp_replace(token, "=+$", "")
    return F.coalesce(*[F.when(bare.rlike(p), F.lit(n)) for n, p, _ in ENCODINGS])


def _pieces(runs: DataFrame) -> DataFrame:
    """The runs (doc_id, tid, kind, token, start); those that fit no encoding by their pieces."""
    whole = F.array(F.struct(F.lit(0).alias("gap"), F.col("token").alias("hit"), F.col("token").alias("inner")))
    parts = F.when(_encoding(F.col("token")).isNotNull(), whole).otherwise(_spans(F.col("token"), PIECE))
    flat = runs.select("doc_id", "tid", "kind", F.col("start").alias("run"), F.posexplode(parts).alias("i", "part"))
    size = F.length("part.hit")
    order = Window.partitionBy("doc_id", "tid", "kind", "run").orderBy("i")
    placed = flat.withColumn("end", F.col("run") + F.sum(F.col("part.gap") + size).over(order))
    return placed.select("doc_id", "tid", "kind", F.col("part.hit").alias("token"), (F.col("end") - size).alias("start"), "end")


def battery(candidates: DataFrame) -> DataFrame:
    """candidates (with token) plus encoding and stat: -ln of the combined p of the three tests. Rows without a fitting encoding go.

    The time is linear in a token's length: encoding and alphabet are chosen once a token and stored, then one fold over its
    characters gives the sums of the runs and correlation tests, and one count for each symbol of the alphabet the squares.
    """
    c = F.col
    alphabet = F.coalesce(*[F.when(c("encoding") == n, F.lit(a)) for n, _, a in ENCODINGS])
    chosen = candidates.withColumn("encoding", _encoding(c("token"))).where("encoding IS NOT NULL").withColumns({"bare": F.regexp_replace("token", "=+$", ""), "alphabet": alphabet})
    df = materialize(chosen.where(F.length("bare") > 2), "tokens").withColumns({"n": F.length("bare").cast("double"), "size": F.length("alphabet").cast("double")})
    codes = F.transform(F.filter(F.split("bare", ""), lambda x: x != ""), lambda x: F.instr(c("alphabet"), x).cast("double") - 1)
    names = ("high", "total", "squares", "products", "changes", "first", "last")
    start = F.struct(*[F.lit(-1.0 if n in ("first", "last") else 0.0).alias(n) for n in names])

    def add(s: Column, x: Column) -> Column:
        half, later = c("size") / 2, s["last"] >= 0
        values = (
            s["high"] + (x >= half).cast("double"),
            s["total"] + x,
            s["squares"] + x * x,
            s["products"] + F.when(later, s["last"] * x).otherwise(0.0),
            s["changes"] + (later & ((s["last"] < half) != (x < half))).cast("double"),
            F.when(later, s["first"]).otherwise(x),
            x,
        )
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    times = lambda x: F.pow(c("n") - F.length(F.replace(c("bare"), x, F.lit(""))), F.lit(2.0))
    df = df.withColumns({"repeats": F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda s, x: s + times(x)), "sums": F.aggregate(codes, start, add)})
    df = df.select("*", "sums.*").withColumn("mean", c("total") / c("n"))
    df = df.withColumns(
        {
            "pairs": c("n") * (c("n") - 1) / c("size"),
            "mean_runs": 2 * c("high") * (c("n") - c("high")) / c("n") + 1,
            "spread": c("squares") - c("n") * c("mean") * c("mean"),
            "cross": c("products") - c("mean") * (2 * c("n") * c("mean") - c("first") - c("last")) + (c("n") - 1) * c("mean") * c("mean"),
        }
    )
    df = df.withColumn("var_runs", (c("mean_runs") - 1) * (c("mean_runs") - 2) / (c("n") - 1))
    df = df.withColumns(
        {
            "z1": (c("repeats") - c("n") - c("pairs")) / F.sqrt(2 * c("pairs") * (1 - 1 / c("size"))),
            "z2": F.when(c("var_runs") > 0, F.abs(c("changes") + 1 - c("mean_runs")) / F.sqrt("var_runs")).otherwise(F.lit(9.0)),
            "z3": F.when(c("spread") > 1e-9, F.abs(c("cross") / c("spread") + 1 / c("n")) * F.sqrt("n")).otherwise(F.lit(9.0)),
        }
    )
    df = df.withColumn("y", -F.log(_normal_tail(c("z1"))) - F.log(F.least(2 * _normal_tail(c("z2")), F.lit(1.0))) - F.log(F.least(2 * _normal_tail(c("z3")), F.lit(1.0))))
    # The tail of chi-squared with 6 degrees of freedom.
    df = df.withColumn("stat", -F.log(F.greatest(F.exp(-c("y")) * (1 + c("y") + c("y") * c("y") / 2), F.lit(1e-20))))
    return df.select(*candidates.columns, "encoding", "stat")


def not_rejected(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """The rows of tested that their stratum's Benjamini-Hochberg control doesn't call structured."""
    length = F.length("token")
    binned = tested.withColumn("stratum", F.when(length < 24, 20).when(length < 32, 24).when(length < 48, 32).when(length < 96, 48).otherwise(96)).withColumn("bin", F.least(F.floor(F.col("stat") / BIN), F.lit(BINS)).cast("int"))
    counts = binned.groupBy("stratum", "bin").count()  # 5 strata of BINS + 1 bins at most
    whole = Window.partitionBy("stratum")
    ranked = counts.withColumn("rank", F.sum("count").over(whole.orderBy(F.desc("bin")))).withColumn("all", F.sum("count").over(whole))
    cut = ranked.where(F.exp(-F.col("bin") * BIN) <= fdr * F.col("rank") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("cut"))
    return binned.join(F.broadcast(cut), "stratum", "left").where("cut IS NULL OR bin < cut").drop("cut", "bin", "stratum")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (long), base_sha256, spans, n_random (long): one row for each row of docs.

    spans is kind:start:end by start, then kind (assign, access, hex, random), comma-joined, in code points, end exclusive.
    Base kinds are leftmost matches of their patterns that don't overlap within a kind; an assigned value under 6 characters,
    an access key under 20 and a hex run under 24 are dropped. random is what the battery adds: runs of 20 or more key
    characters, or their pieces, with digits and letters that look random for their encoding and length. A null text counts as empty: counts
    of 0, no spans, the digest of the empty string. Rows that repeat an id and text have equal values. An empty table gives
    no rows; further columns are ignored. Tokens of any length are tested whole. Texts are read once: their matches lie under
    spark.checkpoint.dir.
    """
    text = F.col("text")
    base = docs.select(named(docs, id_col).alias("doc_id"), text_or_empty(named(docs, text_col)).alias("text")).withColumn("tid", F.xxhash64("text"))
    none = F.array().cast("array<struct<gap:int,hit:string,inner:string>>")

    def kind(k: int, pattern: str, hint: str, group: int = 0) -> Column:
        return F.transform(F.when(text.rlike(hint), _spans(text, pattern, group)).otherwise(none), lambda x: F.struct(F.lit(k).alias("kind"), *[x[c].alias(c) for c in ("gap", "hit", "inner")]))

    hits = F.array(kind(0, ASSIGN, ASSIGN_HINT, 2), kind(1, ACCESS, "AKIA"), kind(2, rf"{HEX[:-1]}{{24,}}", r"[0-9a-f]{24}"), kind(3, RUN, RUN))
    flat = base.select("doc_id", "tid", F.explode(hits).alias("hits")).where(F.size("hits") > 0)
    flat = flat.select("doc_id", "tid", F.posexplode("hits").alias("i", "hit")).select("doc_id", "tid", "i", "hit.*").dropDuplicates(["doc_id", "tid", "kind", "i"])
    size = F.length("hit")
    order = Window.partitionBy("doc_id", "tid", "kind").orderBy("i")
    placed = materialize(flat.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size), "matches")
    found = placed.where((F.col("kind") == 0) & (F.length("inner") >= 6) | (F.col("kind") == 1) & (size >= 20) | (F.col("kind") == 2)).select("doc_id", "tid", "kind", "start", "end")
    both = lambda c: F.col(c).rlike("[0-9]") & F.col(c).rlike("[A-Za-z]")
    mixed = _pieces(placed.where((F.col("kind") == 3) & both("hit")).withColumn("token", F.col("hit"))).where(both("token"))
    random = not_rejected(materialize(battery(mixed), "tested"), fdr).select("doc_id", "tid", "kind", "start", "end")
    names = F.array(*[F.lit(k) for k in KINDS])
    by_doc = found.unionByName(random).groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")

    spans = F.coalesce("s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    ids = base.select("doc_id", "tid").alias("d").join(by_doc.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.tid") == F.col("f.tid")), "left").select("d.doc_id", spans.alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    return ids.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(joined(F.filter("s", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), count(3).alias("n_random"))
