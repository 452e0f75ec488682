"""Secret scans: fixed patterns plus character Markov models compared by log-likelihood ratio.

Spans are code points, end exclusive. Three kinds come from patterns (assign, access, hex); the
kind markov is added for runs of CANDIDATE characters, without the parts that spans of the others or public ids cover, whose
mean log-likelihood ratio per step, random string against ordinary identifier, is over the model's cut. In other
runs it is added for the stretches of 20 characters at least whose ratios less the cut sum to a surplus that
ordinary runs of that length seldom reach anywhere. The two models are first-order chains over 68 characters, counted from labelled
samples (text, label 1: random, 0: ordinary); those of samples() are made, others can be given. A random stretch has LEAST_DISTINCT different characters.

Null text counts as empty: no spans, and the digest of the empty string. Repeated rows each return
a row; an empty table gives no rows; extra columns are ignored by the scan and kept by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded, table

#: The kinds in their order, their patterns, and how long a match must be (assign: its second group).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, LEAST_ACCESS = r"AKIA[A-Z0-9]+", 16
HEX, LEAST_HEX = r"[0-9a-f]+", 32
LEAST_ASSIGN = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE, LEAST_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Ids that are random by design and no secrets: never part of a candidate.
PUBLIC_ID = "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Different characters that a random stretch has at least; rules and numbers have fewer.
LEAST_DISTINCT = 9
#: How many pairs the distribution over single characters counts for, after a character.
BACK_OFF = 20.0
#: Words that ordinary strings are put together from: of code, and of four languages.
STEMS = """get set read write user name list index count value data file path config server client request response handle create update
delete find load store parse format print check test error message event time date width height color style image table column row key node
tree graph page link button label status state order price total number string array object class method function module thinking station
nation under over inter would should people through because without another little between important government nothing question children
the and of to in is that for with as was what where are this from they have one had word but not all were we when your can said there use each
der die das und nicht mit von auf für schiff fahrt gesellschaft dampf donau kraft werk zeug haus bau stadt verwaltung rechts schutz
versicherung geschwindigkeit begrenzung freund schaft lich keit heit ung arbeit geber zwischen durch gegen vertrag straße bahn hof
le la les des une dans pour avec sur que qui plus entre gouvernement développement quelque maintenant toujours beaucoup travail temps
anticonstitutionnellement eau aux tion ment elle euse ateur isation el los las del una con para por como más entre gobierno desarrollo
siempre trabajo tiempo ciudad nuestro internacional ción mente idad ador queda ella""".split()


def samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """n labelled strings (text, label) of each class.

    Random: digests written in hexadecimal, base 64, its form for addresses, base 62, base 32 and small letters with
    digits. Ordinary: stems joined in the ways of code, paths, prose and compounds, with and without numbers; dates,
    versions, counters, long numbers, rules, and lists of settings.
    """
    s = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 512).alias("d")).withColumn("b", F.base64(F.unhex("d")))
    b62 = F.regexp_replace("b", "[^A-Za-z0-9]", "")
    written = [
        F.col("d"), F.upper("d"), F.col("b"), F.translate("b", "+/", "-_"), b62, b62, F.regexp_replace(F.upper("b"), "[^A-Z2-7]", ""), F.lower(b62),
    ]
    start = (F.col("id") % 29 + 1).cast("int")
    rand = F.substring(F.get(F.array(*written), (F.col("id") % len(written)).cast("int")), start, F.lit(40))
    stems = F.expr("split('" + " ".join(STEMS) + "', ' ')")
    pick = F.transform(F.sequence(F.lit(0), (F.col("id") % 5 + 2).cast("int")), lambda k: F.get(stems, F.pmod(F.xxhash64(F.col("id"), k), F.lit(len(STEMS))).cast("int")))
    number = F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("string")
    join = lambda by: F.array_join(pick, by)
    rule = F.repeat(F.get(F.split(F.lit("- = _ + / -= +- =-"), " "), (F.col("id") % 8).cast("int")), 30)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(30_000)).cast("int")).cast("string")
    long_number = F.concat(F.abs(F.xxhash64("id")).cast("string"), F.abs(F.xxhash64("d")).cast("string"))
    usual = [
        F.array_join(F.transform(pick, lambda x: F.initcap(x)), ""), join("_"), join("-"), F.upper(join("_")), join(""), join(""), F.initcap(join("")), join("/"),
        F.concat(F.lit("/"), join("/"), F.lit("/"), number), F.concat(join("_"), F.lit("_"), number), F.concat(join("-"), F.lit("-"), day), F.concat(join("="), number),
        F.concat(join("/"), F.lit("/"), day, F.lit("/"), number), F.upper(join("")), rule, long_number, F.concat(F.upper(F.get(pick, F.lit(0))), F.lit("-"), day, F.lit("-"), number, number),
    ]
    ordinary = F.get(F.array(*usual), (F.col("id") % len(usual)).cast("int"))
    return s.select(rand.alias("text"), F.lit(1).alias("label")).union(s.select(ordinary.alias("text"), F.lit(0).alias("label")))


def log_ratios(pairs: dict[int, dict[tuple[int, int], int]]) -> list[float]:
    """Log-likelihood ratios, random against ordinary, of each pair of places in the alphabet, row by row.

    pairs: counts by label and pair. A pair's probability backs off to the second character's own; pairs that neither
    class was taught say nothing.
    """
    n = len(ALPHABET) + 1
    log_p = {}
    for label, count in pairs.items():
        after, single = [0.0] * n, [1.0] * n
        for (a, b), c in count.items():
            after[a] += c
            single[b] += c
        total = sum(single)
        log_p[label] = lambda a, b, count=count, after=after, single=single, total=total: math.log((count.get((a, b), 0) + BACK_OFF * single[b] / total) / (after[a] + BACK_OFF))
    taught = set(pairs[0]) | set(pairs[1])
    return [log_p[1](a, b) - log_p[0](a, b) if (a, b) in taught else 0.0 for a in range(n) for b in range(n)]


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """The ratio of each pair of characters (row by row, index 0: any other), and the cut.

    Only counts of pairs come to the driver: 2 * 68 * 68 at most. The cut lies halfway between the
    classes' means, measured in their standard deviations.
    """
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring("text", i, F.lit(1)))
    i = F.explode(F.expr("sequence(2, length(text))")).alias("i")
    pairs = labelled.where("length(text) >= 2").select("text", "label", i).select("label", at(F.col("i") - 1).alias("a"), at(F.col("i")).alias("b"))
    count: dict[int, dict[tuple[int, int], int]] = {0: {}, 1: {}}
    for r in pairs.groupBy("label", "a", "b").count().collect():
        count[r.label][r.a, r.b] = r["count"]
    llr = log_ratios(count)
    m = {r.label: r for r in labelled.where("length(text) >= 2").select("label", mean_ratio(F.col("text"), llr).alias("s")).groupBy("label").agg(F.mean("s").alias("m"), F.stddev("s").alias("sd")).collect()}
    return llr, (m[1].m * m[0].sd + m[0].m * m[1].sd) / (m[0].sd + m[1].sd)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def codes(text: Column) -> Column:
    """The places of a text's characters in the alphabet, from 1; 0: any other."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(code: Column, llr: list[float]) -> Column:
    """The ratio of every pair of neighbours, two characters at least."""
    n, ratios = len(ALPHABET) + 1, F.expr(folded(llr))
    last = F.size(code) - 1
    return F.zip_with(F.slice(code, F.lit(1), last), F.slice(code, F.lit(2), last), lambda a, b: F.get(ratios, a * n + b))


def _mean(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)


def mean_ratio(text: Column, llr: list[float]) -> Column:
    return let(codes(text), lambda c: F.when(F.size(c) >= 2, _mean(_steps(c, llr))).otherwise(F.lit(-99.0)))


#: Steps that are folded at once; what they find is then added to the rest, so that long runs take time in proportion.
FOLD = 1024


def stretches(code: Column, model: tuple[list[float], float]) -> Column:
    """Structs (from, to) of the parts of a text (given as codes(), 20 characters at least) that are random: the whole, or stretches with a surplus."""
    llr, cut = model
    least = F.log(F.size(code)) + 3
    part = "struct<from:int,to:int>"
    none = F.array().cast(f"array<{part}>")
    state = lambda i, c, s, best, to, out: F.struct(i.alias("i"), c.alias("c"), s.alias("s"), best.alias("best"), to.alias("to"), out.alias("out"))

    def emitted(a: Column) -> Column:
        good = (a["best"] >= least) & (a["to"] - a["s"] >= LEAST_CANDIDATE)
        return F.when(good, F.concat(a["out"], F.array(F.struct(a["s"].alias("from"), a["to"].alias("to"))))).otherwise(a["out"])

    def step(a: Column, r: Column) -> Column:
        i, c = a["i"] + 1, a["c"] + r - F.lit(cut)
        over = (c <= 0) | (a["best"] - c > least)
        better = state(i, c, a["s"], F.greatest(a["best"], c), F.when(c > a["best"], i).otherwise(a["to"]), a["out"])
        return F.when(over, state(i, F.lit(0.0), i - 1, F.lit(0.0), i, emitted(a))).otherwise(better)

    def fold(a: Column, some: Column) -> Column:
        inside = F.aggregate(some, state(a["i"], a["c"], a["s"], a["best"], a["to"], none), step)
        return let(inside, lambda x: state(x["i"], x["c"], x["s"], x["best"], x["to"], F.concat(a["out"], x["out"])))

    start = state(F.lit(1), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(1), none)
    whole = F.array(F.struct(F.lit(0).alias("from"), F.size(code).alias("to")))
    blocks = lambda steps: F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / FOLD).cast("int")), lambda k: F.slice(steps, k * FOLD + 1, F.lit(FOLD)))
    found = let(_steps(code, llr), lambda s: F.when(_mean(s) > cut, whole).otherwise(F.aggregate(blocks(s), start, fold, emitted)))
    return F.filter(found, lambda p: F.size(F.array_distinct(F.slice(code, p["from"] + 1, p["to"] - p["from"]))) >= LEAST_DISTINCT)


#: Code points that a piece of a text holds, and spans whose ends are compared at once.
PIECE = 256


def _replaced(df: DataFrame, name: str, spans: str, mask) -> DataFrame:
    """df with a column: text with mask(start, end) for each of the spans (sorted), overlapping ones as one; null spans: none.

    Text is cut into pieces once and put together from them, and the end of all spans before each one is found by blocks, so time is in
    proportion to the text.
    """
    div = lambda x: f"cast(floor(({x}) / {PIECE}) as int)"
    df = df.withColumn("_t", F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    i_div = lambda x: F.floor(x / PIECE).cast("int")
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0))
    blocks = lambda e: F.transform(F.sequence(F.lit(0), i_div(F.size(e))), lambda k: most(F.slice(e, k * PIECE + 1, F.lit(PIECE))))
    upto = lambda b: F.transform(b, lambda _, k: most(F.slice(b, F.lit(1), k)))
    before = lambda e, c: F.transform(e, lambda _, i: F.greatest(F.get(c, i_div(i)), most(F.slice(e, i_div(i) * PIECE + 1, i % PIECE))))
    ends = let(F.transform(spans, lambda x: x["end"]), lambda e: let(let(blocks(e), upto), lambda c: before(e, c)))
    df = df.withColumn("_p", F.when(F.size(spans) > 0, ends))
    df = df.withColumn("_last", F.when(F.size(spans) > 0, F.array_max(F.transform(spans, lambda x: x["end"]))))
    cut = lambda a, b: f"""CASE WHEN {b} <= {a} THEN '' WHEN {div(a)} = {div(b)} THEN substring(get(_t, {div(a)}), {a} % {PIECE} + 1, {b} - {a})
        ELSE concat(substring(get(_t, {div(a)}), {a} % {PIECE} + 1), array_join(slice(_t, {div(a)} + 2, {div(b)} - {div(a)} - 1), ''), substring(coalesce(get(_t, {div(b)}), ''), 1, {b} % {PIECE})) END"""  # noqa: E731
    cut = cut("p", "x.start").replace("_t", "t")
    kept = F.expr(f"get(transform(array(_t), t -> array_join(zip_with({spans}, _p, (x, p) -> concat({cut}, {mask('x', 'p')})), '')), 0)")
    end = F.expr(f"substring(coalesce(get(_t, {div('_last')}), ''), _last % {PIECE} + 1)")
    rest = F.expr(f"array_join(slice(_t, {div('_last')} + 2, size(_t)), '')")
    return df.withColumn(name, F.coalesce(F.concat(kept, end, rest), F.col("text"))).drop("_t", "_last", "_p")


def _spans(df: DataFrame, name: str, pattern: str, kind: int, ok, when: str, keep: bool = False, of: str = "text") -> DataFrame:
    """A column of structs (start, kind, end): the leftmost matches that don't overlap and pass ok(match).

    What lies between matches comes from splitting by the same pattern; ends are sums of lengths,
    added up over blocks of 256. Only texts that match the pattern when pay for it. With keep, a struct has its match, m, too.
    """
    text = F.col(of)
    found = F.arrays_zip(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    found = F.filter(found, lambda x: x["m"].isNotNull())
    df = df.withColumn("_m", F.when(text.rlike(when), F.transform(found, lambda x: F.struct((F.length(x["g"]) + F.length(x["m"])).alias("step"), x["m"].alias("m")))))
    # Bound names are worked out once: a column that is used once, inside a lambda, would be worked out for every element.
    div = lambda x: F.floor(x / PIECE).cast("int")
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    blocks = lambda s: F.transform(F.sequence(F.lit(0), div(F.size(s))), lambda k: total(F.slice(s, k * PIECE + 1, F.lit(PIECE))))
    upto = lambda b: F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k)))
    end = lambda s, c, i: F.get(c, div(i)) + total(F.slice(s, div(i) * PIECE + 1, i % PIECE + 1))
    ends = lambda m, s, c: F.transform(m, lambda x, i: F.struct(end(s, c, i).alias("end"), x["m"].alias("m")))
    within = lambda m: let(F.transform(m, lambda x: x["step"]), lambda s: let(let(blocks(s), upto), lambda c: ends(m, s, c)))
    df = df.withColumn("_e", F.when(F.col("_m").isNotNull(), let(F.col("_m"), within)))
    spans = F.transform(F.filter("_e", lambda x: ok(x["m"])), lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), *([x["m"].alias("m")] if keep else [])))
    return df.withColumn(name, F.coalesce(spans, F.array().cast(f"array<struct<start:int,kind:int,end:int{',m:string' if keep else ''}>>"))).drop("_m", "_e")


def scan(documents: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """documents with base and spans: sorted arrays of structs (start, kind, end). No shuffle."""
    df = documents.withColumn("text", F.coalesce("text", F.lit("")))
    df = _spans(df, "assign", ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN, ASSIGN)
    df = _spans(df, "access", ACCESS, 1, lambda m: F.length(m) >= LEAST_ACCESS, ACCESS)
    df = _spans(df, "hex", HEX, 2, lambda m: F.length(m) >= LEAST_HEX, "[0-9a-f]{%d}" % LEAST_HEX)
    df = _spans(df, "ids", PUBLIC_ID, 3, lambda m: F.lit(True), "-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-")
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    df = df.withColumn("covers", F.when(F.size("ids") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "ids"))))
    # With blanks for what is covered, runs of the rest are the parts that may be random.
    df = _replaced(df, "_rest", "covers", lambda x, p: f"repeat(' ', {x}.end - greatest({x}.start, {p}))")
    df = _spans(df, "runs", CANDIDATE, 3, lambda m: F.lit(True), CANDIDATE, keep=True, of="_rest")
    df = df.withColumn("parts", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), codes(r["m"]).alias("codes"))))
    found = F.transform("parts", lambda x: F.transform(stretches(x["codes"], model), lambda y: F.struct((x["start"] + y["from"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + y["to"]).alias("end"))))
    return df.withColumn("spans", F.array_sort(F.concat("base", F.flatten(found)))).drop("_rest")


def _joined(spans: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({kinds}, x.kind), ':', x.start, ':', x.end)), ',')")


def secret_spans(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    model = train(samples(documents.sparkSession) if labelled is None else labelled)
    s = scan(documents.select("doc_id", "text"), model)
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(documents: DataFrame, labelled: DataFrame | None = None, mask: str = "[SECRET]") -> DataFrame:
    """documents with every span, overlapping ones merged, replaced by the mask; all rows and columns stay."""
    model = train(samples(documents.sparkSession) if labelled is None else labelled)
    s = scan(documents.select(F.struct("*").alias("d"), F.col("text").alias("text")), model)
    s = _replaced(s, "_clean", "spans", lambda x, p: f"CASE WHEN {x}.end > {p} AND {x}.start >= {p} THEN '{mask}' ELSE '' END")
    clean = F.col("_clean")
    clean = F.when(F.col("d")["text"].isNull() | (F.size("spans") == 0), F.col("d")["text"]).otherwise(clean)
    return s.select(*[(clean if c == "text" else F.col("d")[c]).alias(c) for c in documents.columns])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
