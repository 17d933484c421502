"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Patterns find assignments, access keys and hexadecimal runs. What they leave is looked at by two models of which character follows which: one trained on
strings labelled random, one on those labelled ordinary. A run of characters is a secret if its log-likelihood ratio is high enough. Labelled are a
sample made by rule (or given), and the corpus's own strings: values that the patterns found are random, the other long runs ordinary. Each
distinct string trains once, and no origin weighs more than a set mass. The texts are read once; all work is in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.llm.common import written

#: Fixed patterns, by kind; a match counts from so many characters of its value.
ASSIGN, ASSIGN_LEAST = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs that the models judge, and the characters they are made of.
RUN = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: States of a model: the start (0), and the characters.
STATES = len(ALPHABET) + 1
#: The least log-likelihood ratio of a secret; transitions that an origin of labels weighs at most; what each transition has beforehand.
THRESHOLD, ORIGIN_MASS, PRIOR = 8.0, 200_000.0, 2.0
#: Parts of the ordinary identifiers of the sample.
PARTS = (
    "get set user name index value data file path list item count total error message request response handler service client server config option "
    "default update create delete insert select table column row key map node tree graph edge first last next previous start end time date string number "
    "buffer stream reader writer parser format version license copyright document content header footer title body text line word page image button "
    "window event listener callback function method class object array result status code type size length width height color style theme model view "
    "controller manager factory builder context session token cache queue stack thread process job task worker pool lock state action reducer test "
    "gesellschaft schiff fahrt haus strasse wissenschaft entwicklung zeitung schule arbeit freund regierung verkehr sicherheit nachricht einstellung "
    "maison travail gouvernement recherche exemple bibliotheque utilisateur ecole mouvement fichier casa trabajo gobierno ejemplo usuario "
    "escuela corazon movimiento archivo busqueda lavoro governo ricerca esempio utente scuola biblioteca movimento"
)
_SPAN = "array<struct<start:bigint,end:bigint,s:string>>"


def spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """The leftmost matches that don't overlap: start and end in characters, and the value (a group of the match). What lies between them gives their places."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = found if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["m"], x["b"], lambda m, b: m + b)
        starts = F.zip_with(T.running_totals(steps), x["b"], lambda at, b: at + b)
        ends = F.zip_with(starts, x["m"], lambda at, m: F.struct(at.alias("start"), (at + m).alias("end")))
        return F.zip_with(ends, values, lambda e, s: F.struct(e["start"].alias("start"), e["end"].alias("end"), s.alias("s")))

    both = F.struct(lengths(found).alias("m"), F.slice(lengths(between), F.lit(1), F.size(found)).alias("b"))
    return F.when(text.rlike(pattern), T.let(both, placed)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def runs(text: Column) -> Column:
    """Runs outside the assignments that hold no other pattern's match, with their places."""

    def apart(text: Column) -> Column:
        gaps, found = F.split(text, ASSIGN, -1), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
        steps = F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda g, m: (g + F.coalesce(m, F.lit(0))).cast("long"))
        at = F.arrays_zip(T.running_totals(steps).alias("o"), gaps.alias("g"))
        each = lambda x: F.transform(spans(x["g"], RUN), lambda m: F.struct((m["start"] + x["o"]).alias("start"), (m["end"] + x["o"]).alias("end"), m["s"].alias("s")))
        return F.flatten(F.transform(at, each))

    alone = F.when(text.rlike(ASSIGN), apart(text)).otherwise(spans(text, RUN))
    free = F.filter(alone, lambda m: ~m["s"].rlike(f"{HEX}|{ACCESS}"))
    return F.when(text.rlike(RUN), free).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def sample_strings(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(s, random) by rule: hash values in several alphabets are random; words in several styles, numbers, times, alphabets and one character again and again are ordinary."""
    pick = lambda i: F.element_at(F.split(F.lit(PARTS), " "), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS.split()))) + 1).cast("int"))
    hashed, words = F.unhex(F.sha2(F.col("id").cast("string"), 256)), [pick(i) for i in range(4)]
    styled = [F.concat_ws("_", *words), F.concat_ws("-", *words), F.upper(F.concat_ws("_", *words)), F.concat(words[0], *[F.initcap(w) for w in words[1:]]), F.concat(*[F.initcap(w) for w in words]), F.concat_ws("/", *words)]
    letter = F.substring(F.lit(ALPHABET), F.pmod("id", F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1))
    time = F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(2_000_000_000))), "yyyy-MM-dd'T'HH-mm-ss")
    plain = [F.concat_ws("", *words), F.repeat(letter, (F.pmod("id", F.lit(50)) + 16).cast("int")), F.substring(F.lit(ALPHABET), F.pmod("id", F.lit(40)).cast("int") + 1, F.lit(20)), time]
    number = F.substring(F.regexp_replace(F.concat(*[F.abs(F.xxhash64("id", F.lit(i))).cast("string") for i in (7, 8)]), "-", ""), 1, 20)
    random = [F.base64(hashed), F.lower(F.hex(hashed)), F.upper(F.hex(hashed)), F.translate(F.base64(hashed), "+/=", "-_"), F.upper(F.translate(F.base64(hashed), "+/=", "")), F.lower(F.translate(F.base64(hashed), "+/=", ""))]
    ids = spark.range(n)
    return ids.select(F.explode(F.array(*random)).alias("s"), F.lit(True).alias("random")).union(ids.select(F.explode(F.array(*styled, *plain, number)), F.lit(False)))


def _state(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def ratios(samples: DataFrame) -> list[float]:
    """ln P(b | a, random) - ln P(b | a, ordinary) at place a * STATES + b. samples: (s, random, origin); other characters than ALPHABET's aren't counted.

    Distinct strings count once. An origin's transitions of a label weigh ORIGIN_MASS together at most, however many strings it has.
    """
    chars = F.split("s", "")
    pairs = F.transform(F.arrays_zip(F.concat(F.array(F.lit("")), chars).alias("a"), chars.alias("b")), lambda p: F.when(p["b"].isNotNull() & (p["b"] != ""), F.struct(F.when(p["a"] == "", 0).otherwise(_state(p["a"])).alias("a"), _state(p["b"]).alias("b"))))
    each = samples.where("s <> ''").distinct().select("random", "origin", F.inline(F.filter(pairs, lambda p: p.isNotNull() & (p["b"] > 0))))
    n = each.groupBy("random", "origin", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    mass = n.withColumn("n", F.col("n") * F.least(F.lit(1.0), ORIGIN_MASS / F.sum("n").over(Window.partitionBy("random", "origin"))))
    of = lambda random: F.sum(F.when(F.col("random") == random, F.col("n")))
    cells = samples.sparkSession.range(STATES * STATES).select(F.floor(F.col("id") / STATES).cast("int").alias("a"), F.pmod("id", F.lit(STATES)).cast("int").alias("b"))
    both = cells.join(mass.groupBy("a", "b").agg(of(True).alias("r"), of(False).alias("o")), ["a", "b"], "left").select("a", "b", *[(F.coalesce(k, F.lit(0.0)) + PRIOR).alias(k) for k in "ro"])
    after = Window.partitionBy("a")
    ln = lambda k: F.log(F.col(k) / F.sum(k).over(after))
    cell = both.select((F.col("a") * STATES + F.col("b")).alias("at"), (ln("r") - ln("o")).alias("x"))
    # STATES * STATES numbers
    return cell.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("x")).first()["x"]


def log_ratio(s: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string of ALPHABET's characters."""
    held = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    step = lambda acc, c: T.let(_state(c), lambda b: F.struct(b.alias("a"), (acc["x"] + F.coalesce(F.get(held, acc["a"] * STATES + b), F.lit(0.0))).alias("x")))
    return F.aggregate(F.split(s, ""), F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("x")), step, lambda acc: acc["x"])


def found(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, random) of each row: arrays of (start, end, s), in characters, the end not included; s is the value, or the run.

    samples: (s, random) strings with labels, beside the corpus's own; sample_strings() if none are given. Spans of one kind don't overlap; a random run overlaps
    no other kind's. A null or empty text has none. Equal rows have equal results. An empty table gives an empty result. Other columns aren't read.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    long = F.filter(spans(text, ASSIGN, 1), lambda m: F.length(m["s"]) >= ASSIGN_LEAST)
    seen = written(picked.select("doc_id", long.alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), runs(text).alias("runs")), "secret-spans")
    own = lambda column, random: seen.select(F.explode(F.transform(column, lambda m: m["s"])).alias("s"), F.lit(random).alias("random"))
    values = F.filter(F.concat("assign", "access", "hex"), lambda m: m["s"].rlike(f"^{RUN}$"))
    labelled = (samples or sample_strings(spark)).select("s", "random", F.lit("given").alias("origin")).union(own(values, True).union(own(F.col("runs"), False)).withColumn("origin", F.lit("corpus")))
    model = ratios(labelled)
    return seen.select("doc_id", "assign", "access", "hex", F.filter("runs", lambda m: log_ratio(m["s"], model) >= threshold).alias("random"))


def joined(kinds: list[str]) -> Column:
    """kind:start:end of the spans of those kinds, by start and then kind, joined by commas."""
    tag = lambda i: lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"))
    tagged = [F.transform(k, tag(i)) for i, k in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest(secrets: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of found()'s rows."""
    counts = {f"n_{k}": F.size(k).cast("long") for k in KINDS}
    return secrets.select("doc_id", *[counts[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(list(KINDS[:3])), 256).alias("base_sha256"), joined(list(KINDS)).alias("spans"), counts["n_random"].alias("n_random"))
