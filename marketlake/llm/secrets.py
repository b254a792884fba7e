"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Three base patterns (assign, access, hex) are matched leftmost and without overlap. Beyond them,
long tokens are tested for randomness. A token's encoding is inferred from its characters (hex,
base32, base36, base62, base64, ...). Against uniform draws from that alphabet:

* chi-squared of the character counts (as a normal deviate after Wilson and Hilferty),
* runs of symbols in the lower and upper half of the alphabet,
* serial correlation of successive symbol numbers.

Their squared deviates add up to a statistic, small for random tokens. Which values are small
enough is decided per length class, since short tokens say little: tokens of letters in one case
(prose) are decoys, tokens with digits or mixed case are candidates. The largest statistic is
found up to which decoys / candidates stays within FDR; beyond it nothing is reported. It never
exceeds CUTOFF, which random tokens exceed once in a thousand. Counts by class and value
form a small table, whatever the corpus. Tokens that overlap a base match are not reported twice.

All steps are DataFrame functions within one row, then one aggregate. A text is searched once per
pattern, and where a pattern occurs, cut and read once more for its matches.

Edge cases: NULL or empty texts have no spans. Repeated rows are returned as often as they occur
and count as often. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.common import materialize, table, whole_text

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# maximal runs, so that the least length may stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
FDR = 0.01
CUTOFF = 16.27
#: Values of the statistic are counted in steps of 1 / STEP up to CUTOFF.
STEP = 8
#: Lower ends of the length classes.
LENGTHS = (20, 24, 32, 48, 80)
ALPHABETS = (
    ("digits", "0123456789", "[0-9]+"),
    ("hex", "0123456789abcdef", "[0-9a-f]+"),
    ("hex_upper", "0123456789ABCDEF", "[0-9A-F]+"),
    ("lower", "abcdefghijklmnopqrstuvwxyz", "[a-z]+"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[A-Z]+"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "[A-Z2-7]+"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", "[0-9a-z]+"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[0-9A-Z]+"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "[0-9A-Za-z]+"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "[0-9A-Za-z+/]+"),
    ("base64_url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "[0-9A-Za-z_-]+"),
)
ANY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Matches whose ends are added up together; sums of so many go into the next level.
BLOCK = 64


def running(values: Column, start: Column) -> Column:
    """For each value of an int array, start plus the sum of the values before it."""
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    none = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, none, step, lambda acc: acc["out"])


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of all matches; value is the given group.

    Pieces between matches and matches alternate, so starts are running sums of their lengths. An array
    is copied with every entry appended, so sums run over blocks, and over the blocks' totals.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def blocked(sized: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(sized), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(first, lambda i: F.slice(sized, i, BLOCK))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))

        def placed(block: Column, at: Column) -> Column:
            ends = running(F.transform(block, lambda x: x["gap"] + x["size"]), at)

            def span(x: Column, begin: Column) -> Column:
                start = begin + x["gap"]
                value = x["hit"] if group == 0 else F.regexp_extract(x["hit"], pattern, group)
                return F.struct(start.alias("start"), (start + x["size"]).alias("end"), value.alias("value"))

            return F.zip_with(block, ends, span)

        return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), placed))

    sized = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(hits)),
        hits,
        lambda piece, hit: F.struct(F.length(piece).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")),
    )
    # through a one-element array, so that what is cut from the text is computed once
    found = F.flatten(F.transform(F.array(sized), blocked))
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(SPAN)


def alphabet_of(token: Column) -> Column:
    """The characters of the token's inferred encoding, in order."""
    alphabet = F.lit(ANY)
    for _, chars, pattern in reversed(ALPHABETS):
        alphabet = F.when(token.rlike(f"^{pattern}$"), F.lit(chars)).otherwise(alphabet)
    return alphabet


def statistic(token: Column, alphabet: Column) -> Column:
    """The sum of squared deviates of the three tests; NULL for a token without two halves.

    Both arguments are read once per symbol, so they should be fields and not computations.
    """
    k = F.length(alphabet).cast("double")
    n = F.length(token).cast("double")

    counts = F.transform(F.split(alphabet, ""), lambda c: F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) - n
    df = k - 1
    spread = F.lit(2.0) / (9 * df)
    uneven = F.greatest((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread), F.lit(0.0))

    # sums over symbols and neighbours in one pass: n high, runs, v, v v, v next
    start = F.struct(
        F.lit(-1.0).alias("last"), *[F.lit(0.0).alias(x) for x in ("high", "runs", "first", "s", "ss", "sn")]
    )

    def step(a: Column, c: Column) -> Column:
        v = (F.instr(alphabet, c) - 1).cast("double")
        begun = a["last"] >= 0
        upper, was = v * 2 >= k, a["last"] * 2 >= k
        return F.struct(
            v.alias("last"),
            (a["high"] + upper.cast("double")).alias("high"),
            (a["runs"] + (~begun | (upper != was)).cast("double")).alias("runs"),
            F.when(begun, a["first"]).otherwise(v).alias("first"),
            (a["s"] + v).alias("s"),
            (a["ss"] + v * v).alias("ss"),
            (a["sn"] + F.when(begun, a["last"] * v).otherwise(F.lit(0.0))).alias("sn"),
        )

    def finish(a: Column) -> Column:
        low = n - a["high"]
        mean = 2 * a["high"] * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(var > 0, (a["runs"] - mean) / F.sqrt(var))
        centre = a["s"] / n
        cov = a["sn"] - centre * (2 * a["s"] - a["first"] - a["last"]) + (n - 1) * centre * centre
        energy = a["ss"] - n * centre * centre
        serial = F.when(energy > 0, (cov / energy + 1 / n) * F.sqrt(n))
        return runs * runs + serial * serial

    return uneven * uneven + F.aggregate(F.split(token, ""), start, step, finish)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind, and the long tokens (start, end, stat, len_class, decoy)."""
    text = docs.select("doc_id", whole_text().alias("text"))
    t = F.col("text")
    found = text.select(
        "doc_id",
        F.filter(matches(t, ASSIGN, 1), lambda x: F.length(x["value"]) >= 6).alias("assign"),
        matches(t, ACCESS).alias("access"),
        matches(t, HEX).alias("hex"),
        matches(t, TOKEN).alias("tokens"),
    )

    def encoded(x: Column) -> Column:
        fields = [x[k].alias(k) for k in ("start", "end", "value")]
        return F.struct(*fields, alphabet_of(x["value"]).alias("alphabet"))

    def tested(x: Column) -> Column:
        size = F.length(x["value"])
        length_class = F.lit(0)
        for i, low in enumerate(LENGTHS):
            length_class = F.when(size >= low, F.lit(i)).otherwise(length_class)
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            statistic(x["value"], x["alphabet"]).alias("stat"),
            length_class.alias("len_class"),
            x["value"].rlike("^([a-z]+|[A-Z]+|[A-Z][a-z]+)$").alias("decoy"),
        )

    def free(x: Column) -> Column:
        clear = F.lit(True)
        for kind in ("assign", "access", "hex"):
            clear = clear & ~F.exists(kind, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return clear

    plain = lambda kind: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(kind)
    return found.select(
        "doc_id",
        plain("assign"),
        plain("access"),
        plain("hex"),
        F.transform(F.transform(F.filter("tokens", free), encoded), tested).alias("tokens"),
    )


def thresholds(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row, by_class: array of the largest accepted bin of each length class (-1: none)."""
    tokens = scanned.select(F.explode("tokens").alias("x")).where("x.stat <= " + str(CUTOFF))
    bins = tokens.groupBy(F.col("x.len_class").alias("len_class"), F.floor(F.col("x.stat") * STEP).cast("int").alias("bin")).agg(
        F.count_if("x.decoy").alias("decoys"), F.count_if(~F.col("x.decoy")).alias("targets")
    )
    up_to = Window.partitionBy("len_class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select("len_class", "bin", F.sum("decoys").over(up_to).alias("d"), F.sum("targets").over(up_to).alias("t"))
    last = sums.where(F.col("d") <= fdr * F.col("t")).groupBy("len_class").agg(F.max("bin").alias("bin"))
    cells = F.map_from_entries(F.collect_list(F.struct("len_class", "bin")))
    return last.agg(cells.alias("m")).select(
        F.array(*[F.coalesce(F.element_at("m", i), F.lit(-1)) for i in range(len(LENGTHS))]).alias("by_class")
    )


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    scanned = materialize(scan(docs))
    limited = scanned.withColumn("by_class", thresholds(scanned, fdr).scalar())
    accepted = F.filter(
        "tokens",
        lambda x: ~x["decoy"] & (x["stat"] <= CUTOFF) & (F.floor(x["stat"] * STEP) <= F.get("by_class", x["len_class"])),
    )

    def named(spans: Column | str, kind: str, order: int) -> Column:
        return F.transform(
            spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.concat(named("assign", "assign", 0), named("access", "access", 1), named("hex", "hex", 2))
    long = lambda c: F.size(c).cast("long")
    return limited.select(
        "doc_id",
        long("assign").alias("n_assign"),
        long("access").alias("n_access"),
        long("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, named(accepted, "random", 3))).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
