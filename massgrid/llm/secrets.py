"""Secret scans by DataFrame expressions alone: fixed patterns, and character Markov models of random strings.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a run of token characters is a secret if its mean log-likelihood ratio is above a threshold
that is calibrated on the samples, too. Both models together are one table of weights by character pair, whose
size is fixed by the alphabet.

A span is (kind, start, end) in code points, end exclusive. Base kinds are assign, access and hex; `random` spans
are added in what the base spans leave: runs, and of ordinary runs their parts between separators. Everything is narrow, inside the scan of the table.

Cases: a null or empty text has no spans; kinds are matched independently and may overlap one another; an empty
table gives an empty result; repeated rows are scanned each; other columns are ignored. Long texts are scanned whole, and
the time grows in proportion to the text, whether it is one run or holds many.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid.llm.common import text_rows

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Lengths stand in the patterns: a run that is long enough matches from its start, a shorter one nowhere.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Parts of a run that are judged on their own where the whole run is ordinary.
PART = r"[A-Za-z0-9]{20,}"
SPANS = "array<struct<start:int,kind:int,end:int,s:string>>"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Parts of ordinary identifiers, which the samples combine.
PARTS = (
    "account address array async base batch buffer build byte cache call client close code column config connect content context convert count create current data date default delete "
    "document element entry error event export field file filter find first format function get group handler hash header height image import index info init input insert internal item key "
    "label last layer length level limit line list load local lock log main manager map match max message method min model module name next node number object offset open option order output "
    "page parent parse path pattern point port position process property query queue read record region remove render request reset result return root row run save schema score search section "
    "select send server service session set size sort source stack start state status step stop store stream string style sum table target task temp test text thread time title total tree type "
    "update upload user util value vector version view width window word write zone the of and ing tion er en le la de ou in on re an es"
).split()
SAMPLES = 6000
#: Values that are folded at once, and characters of a text that are counted at once.
STRIDE, CHUNK = 128, 1024


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(random boolean, s): n random strings in base 64, base 32-like capitals and hex, and n identifiers of 3 to 6 parts."""
    noise = F.sha2(F.concat(F.lit("noise"), F.col("id").cast("string")), 512)
    kinds = [F.rtrim(F.translate(F.base64(F.unhex(noise)), "=", " ")), F.upper(F.translate(noise, "abcdef0123456789", "KQXZJWAG23457VHT")), noise, F.translate(F.base64(F.unhex(noise)), "+/=", "-_")]
    random = reduce(lambda a, k: a.when(F.col("id") % 4 == k, kinds[k]), range(1, 4), F.when(F.col("id") % 4 == 0, kinds[0]))
    parts = F.array(*map(F.lit, PARTS))
    pick = [F.element_at(parts, (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(PARTS))) + 1).cast("int")) for k in range(6)]
    size = (3 + F.col("id") % 4).cast("int")
    number = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(3000)).cast("string")
    words = F.concat(F.slice(F.array(*pick), 1, size), F.when(F.col("id") % 3 == 0, F.array(number)).otherwise(F.array().cast("array<string>")))
    camel = F.array_join(F.transform(words, F.initcap), "")
    joined = [F.array_join(words, "_"), camel, F.array_join(words, "-"), F.array_join(words, "/"), F.array_join(words, ""), F.upper(F.array_join(words, "_"))]
    plain = reduce(lambda a, k: a.when(F.col("id") % 6 == k, joined[k]), range(1, 6), F.when(F.col("id") % 6 == 0, joined[0]))
    ids = spark.range(n)
    return ids.select(F.lit(True).alias("random"), F.substring(random, 1, 24 + (F.col("id") % 40).cast("int")).alias("s")).union(ids.select(F.lit(False), plain))


def pair_weights(labelled: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all pairs of the alphabet, row by row; each count starts at 1/2."""
    k = len(ALPHABET)
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    pairs = labelled.where(F.length("s") > 1).select("random", "s", at.alias("i")).select("random", F.instr(F.lit(ALPHABET), F.col("s").substr(F.col("i"), F.lit(1))).alias("a"), F.instr(F.lit(ALPHABET), F.col("s").substr(F.col("i") + 1, F.lit(1))).alias("b"))
    counts = pairs.where("a > 0 and b > 0").groupBy("random", "a", "b").count()
    every = labelled.sparkSession.range(k * k).select((F.floor(F.col("id") / k) + 1).cast("int").alias("a"), (F.col("id") % k + 1).cast("int").alias("b"))
    table = every.join(counts.where("random").select("a", "b", F.col("count").alias("r")), ["a", "b"], "left").join(counts.where("not random").select("a", "b", F.col("count").alias("o")), ["a", "b"], "left").select("a", "b", (F.coalesce("r", F.lit(0)) + 0.5).alias("r"), (F.coalesce("o", F.lit(0)) + 0.5).alias("o"))
    rows = table.groupBy("a").agg(F.sum("r").alias("r_all"), F.sum("o").alias("o_all")).join(table, "a")
    found = {(x.a, x.b): x.w for x in rows.select("a", "b", (F.log(F.col("r") / F.col("r_all")) - F.log(F.col("o") / F.col("o_all"))).alias("w")).collect()}  # as many rows as the alphabet has pairs
    return [round(found[a + 1, b + 1], 4) for a in range(k) for b in range(k)]


class Model:
    """Weights and threshold of the likelihood ratio."""

    def __init__(self, weights: list[float], threshold: float):
        self.weights, self.threshold = weights, threshold

    def score(self, s: Column) -> Column:
        """Mean log-likelihood ratio by character pair; above 0 the string is likelier to be random."""
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<double>")  # folded to a constant
        places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))  # a substr by place would count from the start each time
        start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), F.when(acc["last"] > 0, acc["sum"] + F.element_at(table, (acc["last"] - 1) * len(ALPHABET) + p)).otherwise(acc["sum"]).alias("sum"))
        return F.aggregate(places, start, step, lambda acc: acc["sum"]) / (F.length(s) - 1)

    @classmethod
    def trained(cls, labelled: DataFrame, false_alarms: float = 0.002) -> Model:
        """The threshold lets through `false_alarms` of the ordinary samples, and is never below 0."""
        model = cls(pair_weights(labelled), 0.0)
        ordinary = labelled.where("not random").select(model.score(F.col("s")).alias("x"))
        model.threshold = max(0.0, float(ordinary.agg(F.percentile("x", F.lit(1 - false_alarms))).first()[0] or 0.0))
        return model


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; lambdas compute what they capture again for each element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For every place, and the one after the last, what the values before it combine to, 0 being the start.

    In two levels, blocks of STRIDE values and their totals, so the time grows in proportion to the values.
    """
    zero = F.lit(0)
    fold = lambda x, start, n: F.aggregate(F.slice(x, start, n), zero, combine)
    totals = lambda v: F.transform(F.sequence(zero, F.floor(F.size(v) / STRIDE).cast("int")), lambda b: fold(v, b * STRIDE + 1, F.lit(STRIDE)))
    ahead = lambda t: F.aggregate(t, F.array(zero), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))
    place = lambda v, h: F.transform(F.sequence(zero, F.size(v)), lambda i: let(F.floor(i / STRIDE).cast("int"), lambda b: combine(h[b], fold(v, b * STRIDE + 1, i % STRIDE))))
    return let(values, lambda v: let(ahead(totals(v)), lambda h: place(v, h)))


def located(text: Column, pattern: str, number: int, group: int = 0, least: int = 1) -> Column:
    """(start, kind, end, s) of every match, leftmost first and non-overlapping: the lengths of what lies between the matches give the places.

    A match whose group is shorter than `least` takes up its text but is left out.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    sizes = lambda p: F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["s"]), F.lit(0)))

    def span(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        row = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(x["s"])).alias("end"), x["s"].alias("s"))
        return F.when(F.length(x["g"]) >= least, row)  # after the last gap comes no match

    spans = let(pieces, lambda p: let(running(sizes(p), lambda a, b: a + b), lambda before: F.filter(F.transform(p, lambda x, i: span(x, before[i])), lambda x: x.isNotNull())))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def rewritten(text: Column, spans: Column, place: Callable[[Column, Column], Column]) -> Column:
    """The text with every span replaced by place(span, where the spans before it end). spans: by start; they may overlap.

    The text is cut up once, so that no piece of it is counted out from its start.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut(c: Column, start: Column, n: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        return F.when(n > 0, F.array_join(F.slice(c, first + 1, F.floor((start + n - 1) / CHUNK).cast("int") - first + 1), "").substr(start % CHUNK + 1, n)).otherwise("")

    def piece(c: Column, x: Column, at: Column) -> Column:
        return F.concat(cut(c, at, x["start"] - at), place(x, at))

    def joined(c: Column, x: Column, ends: Column) -> Column:
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(F.transform(x, lambda x, i: piece(c, x, ends[i])), ""), cut(c, last, F.length(text) - last))

    ends = lambda x: running(F.transform(x, lambda y: y["end"]), lambda a, b: F.greatest(a, b))
    done = let(chunks, lambda c: let(spans, lambda x: let(ends(x), lambda e: joined(c, x, e))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, base, added): arrays of (start, kind, end, s) by start and then kind; kind counts KINDS from 0."""
    return _scanned(text_rows(docs), model, ["doc_id", "text"])


def _scanned(rows: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    text = F.col("text")
    rows = rows.select(*columns, located(text, ASSIGN, 0, 2, 8).alias("assign"), located(text, ACCESS, 1).alias("access"), located(text, HEX, 2).alias("hex"), located(text, RUN, 3).alias("runs"))
    rows = rows.select(*columns, F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "runs")
    rows = rows.select(*columns, "base", F.when((F.size("base") > 0) & (F.size("runs") > 0), located(blanked(text, F.col("base")), RUN, 3)).otherwise(F.col("runs")).alias("runs"))
    random = lambda r: r["s"].rlike("[A-Za-z]") & (model.score(r["s"]) > model.threshold)
    moved = lambda p, by: F.struct((p["start"] + by).alias("start"), p["kind"].alias("kind"), (p["end"] + by).alias("end"), p["s"].alias("s"))
    parts = lambda r: F.filter(F.transform(located(r["s"], PART, 3), lambda p: moved(p, r["start"])), random)
    judged = lambda r: F.when(random(r), F.array(r)).when(r["s"].rlike("[+/_=-]"), parts(r)).otherwise(F.array().cast(SPANS))
    return rows.select(*columns, "base", F.when(F.size("runs") > 0, F.flatten(F.transform("runs", judged))).otherwise(F.col("runs")).alias("added"))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of all spans. spans: by start."""
    return rewritten(text, spans, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], at), F.lit(0))))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or group of overlapping spans, replaced by the mark. spans: by start."""
    return rewritten(text, spans, lambda x, at: F.when(x["start"] < at, F.lit("")).otherwise(F.lit(mark)))


def cleaned(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, and every secret in `text` redacted."""
    rows = docs.select(F.col("text"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    text = redacted(F.col("text"), F.array_sort(F.concat("base", "added")))
    found = _scanned(rows, model, ["text", "row"]).select(text.alias("text"), "row")
    return found.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: secrets of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Model.trained(samples(spark)))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))
