"""People in titles and texts: who takes part in an episode, who is named where, and who speaks. Built-in functions but for the names of a dictionary in texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.functions import text as T

# Forms of names and roles, words that tell of speech, titles of shows that are no names.
NAME = r"[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+){1,3}"
NAME_TOKEN = "[A-Za-z][A-Za-z'’-]+"
ROLE = "([ぁ-んァ-ヴー一-龥A-Za-z0-9・ー]{2,20})役の([ぁ-んァ-ヴー一-龥A-Za-z・ー﨑]{2,16})"
SPEECH = r"explains?|describes?|says?|shares?|recalls?|reflects?|discusses?|argues?|notes?|breaks?\s+down|defines?|remembers?|tells?"
SPEECH_JA = "話す|語る|説明|述べる|振り返る|明かす|答える"
TOGETHER, TOGETHER_JA = "conversation|discussion|speakers?|they|interview", "会話|対談|出演者|一同|二人|三人"
SHOWS = ["mind the game"]

WORD = r"[\p{L}\p{N}_]+"
#: What stands between words.
GAP = r"[^\p{L}\p{N}_]+"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def surname(name: Column) -> Column:
    """The last Latin token of a name that has two or more; else null."""
    return T.let(F.regexp_extract_all(name, F.lit(NAME_TOKEN), F.lit(0)), lambda t: F.when(F.size(t) >= 2, F.element_at(t, -1)))


def aliases(name: Column) -> Column:
    """What a name goes by: itself, and its surname if that has four letters or more."""
    last = surname(name)
    return F.array_compact(F.array(name, F.when(F.length(last) >= 4, last)))


def episode_context(episodes: DataFrame) -> DataFrame:
    """episodes (…, title, intro) with cast_names, primary_subject, participants and role_claims, as their titles and first words give them.

    Cast are the first 8 names after a cast mark; the subject stands before "Interview"; other participants are names in the parts of the title after its first.
    Participants are distinct, the subject first, 12 at most; claims of roles (name, role) are distinct, 8 at most. A null title or intro gives none.
    """
    title, intro = T.clean(F.col("title")), T.clean(F.col("intro"))
    cleaned = lambda xs: F.filter(F.transform(xs, T.clean), lambda x: x != "")
    cast = F.slice(cleaned(F.split(F.regexp_extract(title, "出演[:：](.+)", 1), "[、,／/]")), 1, 8)
    subject = F.regexp_replace(T.clean(F.regexp_extract(title, rf"(?i){_BEFORE}(?:The\s+)?(.+?)\s+Interview{_AFTER}", 1)), r"(?i)^(?:an?|the)\s+", "")
    rest = lambda parts: F.slice(parts, F.lit(2), F.size(parts))
    others = cleaned(F.flatten(F.transform(T.let(F.split(title, "[|｜]"), rest), lambda p: F.split(p, r"\s+(?:and|with|&)\s+|[,、／/]"))))
    upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    named = F.filter(others, lambda x: ~upper(x) & ~F.lower(x).isin(SHOWS) & x.rlike(f"^(?:{NAME})$"))
    d = episodes.withColumns({"cast_names": cast, "primary_subject": T.clipped(subject, 80), "named": named})
    first = F.when(F.col("primary_subject") != "", F.array("primary_subject")).otherwise(F.array().cast("array<string>"))
    found = [F.regexp_extract_all(intro, F.lit(ROLE), F.lit(i)) for i in (1, 2)]
    claims = F.zip_with(found[1], found[0], lambda n, r: F.struct(T.clean(n).alias("name"), T.clean(r).alias("role")))
    d = d.withColumn("participants", F.slice(F.array_distinct(F.concat(first, "cast_names", "named")), 1, 12))
    return d.withColumn("role_claims", F.slice(F.array_distinct(F.filter(claims, lambda c: (c["name"] != "") & (c["role"] != ""))), 1, 8)).drop("named")


def named_in(text: Column, names: Column) -> Column:
    """The names of the array of which an alias stands in the text as whole words, in any case, distinct in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    stands = lambda a: F.regexp_like(low, F.concat(F.lit(_BEFORE), _quoted(F.lower(a)), F.lit(_AFTER)))
    return F.array_distinct(F.filter(F.filter(F.transform(names, T.clean), lambda n: n != ""), lambda n: F.exists(aliases(n), stands)))


def attributed(sections: DataFrame) -> DataFrame:
    """sections (…, value, participants, primary_subject, role_claims) with speaker, speaker_role and speaker_confidence.

    A speaker is named if exactly one participant is named in the section, and a verb of speech follows within 48 characters of the sentence (24 in Japanese).
    With none or several names nobody is: who speaks would be a guess. One name without such a verb, among several participants who are spoken of together, gives them all.
    """
    d = sections.withColumn("one", T.let(named_in(F.col("value"), F.col("participants")), lambda n: F.when(F.size(n) == 1, n[0])))
    value, one = F.coalesce("value", F.lit("")), F.col("one")
    either = F.concat(F.lit("(?:"), F.concat_ws("|", _quoted(one), _quoted(surname(one))), F.lit(")"))
    english = F.regexp_like(value, F.concat(F.lit("(?i)"), either, F.lit(rf"{_AFTER}[^.!?]{{0,48}}{_BEFORE}(?:{SPEECH}){_AFTER}")))
    japanese = F.regexp_like(value, F.concat(either, F.lit(rf".{{0,24}}(?:{SPEECH_JA})")))
    together = (F.size("participants") > 1) & value.rlike(rf"(?i){_BEFORE}(?:{TOGETHER}){_AFTER}|(?:{TOGETHER_JA})")
    claim = F.get(F.filter("role_claims", lambda c: c["name"] == one), F.lit(0))["role"]
    role = F.coalesce(claim, F.when(one == F.col("primary_subject"), "interview subject").otherwise("participant"))
    found = (
        F.when(one.isNull(), F.lit(None)).when(english | japanese, F.struct(one.alias("s"), role.alias("r"), F.lit("named_in_section").alias("c")))
        .when(together, F.struct(F.lit("Multiple speakers").alias("s"), F.array_join("participants", ", ").alias("r"), F.lit("episode_context").alias("c")))
    )
    d = d.withColumn("found", F.coalesce(found, F.struct(F.lit("Unknown speaker").alias("s"), F.lit("").alias("r"), F.lit("unattributed").alias("c"))))
    return d.withColumns({"speaker": F.col("found.s"), "speaker_role": F.col("found.r"), "speaker_confidence": F.col("found.c")}).drop("one", "found")


#: Names whose aliases are sent to every task; with more, runs of words are made rows and both sides are shuffled.
FEW = 100_000


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, start, end, ambiguous) of every place where an alias of a name stands in a text (id, text) as whole words, in any case.

    The runs of words in each text that are as long as some alias, with their places, meet the aliases by equality, so the work doesn't grow with the product of texts and
    names. With FEW names or fewer that is done within the row, in parts of Arrow batches, and only what is found becomes rows. An alias of several names gives a row for each,
    marked ambiguous. Aliases that don't begin and end with a word are never found.
    """
    n = names.select(T.clean(F.col("name")).alias("name")).where("name <> ''").distinct()
    a = n.select("name", F.explode(F.array_distinct(F.transform(aliases(F.col("name")), F.lower))).alias("alias"))
    a = a.where(F.col("alias").rlike(f"^{WORD}") & F.col("alias").rlike(f"{WORD}$"))
    a = a.join(a.groupBy("alias").agg((F.count(F.lit(1)) > 1).alias("ambiguous")), "alias")
    d = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = a.select("name", "ambiguous", _pieces(F.col("alias")).alias("pieces")).limit(2 * FEW + 1).collect()  # a name has two aliases at most
    found = _found_in_row(d, held) if len(held) <= 2 * FEW else _found_by_join(d, a)
    # a name that stands somewhere by itself and by its surname is there once
    return found.groupBy("id", "name", "end").agg(F.min("start").alias("start"), F.min("ambiguous").alias("ambiguous")).select("id", "name", "start", "end", "ambiguous")


def _pieces(low: Column) -> Column:
    """Words and what stands between them, by turns: together the whole text."""
    return F.regexp_extract_all(low, F.lit(f"{WORD}|{GAP}"), F.lit(0))


def _found_in_row(texts: DataFrame, held: list) -> DataFrame:
    """(id, name, start, end, ambiguous) over (id, low): pieces of a text follow a tree of the aliases' pieces, step by step for all places of a part of a batch at once.

    held: rows (name, ambiguous, pieces), which go to every task.
    """
    vocabulary = {p: i for i, p in enumerate(sorted({p for r in held for p in r["pieces"]}))}
    # steps[j]: sorted (state before * pieces + piece); a state is its place there. ends[j]: the rows of held that end in a state.
    steps, ends, states = [], [], [0] * len(held)
    for j in range(max((len(r["pieces"]) for r in held), default=0)):
        alive = [i for i, r in enumerate(held) if len(r["pieces"]) > j]
        keys = {i: states[i] * len(vocabulary) + vocabulary[held[i]["pieces"][j]] for i in alive}
        steps.append(sorted(set(keys.values())))
        place = {k: s for s, k in enumerate(steps[-1])}
        ends.append([[] for _ in place])
        for i in alive:
            states[i] = place[keys[i]]
            if len(held[i]["pieces"]) == j + 1:
                ends[-1][states[i]].append(i)
    sent = texts.sparkSession.sparkContext.broadcast((list(vocabulary), [r["name"] for r in held], [r["ambiguous"] for r in held], steps, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, names, ambiguous, steps, ends = sent.value
        known, names, ambiguous = pa.array(pieces, pa.string()), pa.array(names, pa.string()), pa.array(ambiguous, pa.bool_())
        steps = [np.array(s, np.int64) for s in steps]
        # of each state, where its rows of held begin in one list of them
        firsts = [np.r_[0, np.cumsum([len(x) for x in e])] for e in ends]
        lasts = [np.array([i for x in e for i in x], np.int64) for e in ends]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                flat, count = part.column(1).flatten(), pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy()
                row, code = np.repeat(np.arange(len(count)), count), pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy().astype(np.int64)
                length = pc.utf8_length(flat).to_numpy().astype(np.int64)
                total = np.r_[0, np.cumsum(length)]
                # characters before each piece in its own text
                before = total[:-1] - total[np.r_[0, np.cumsum(count)[:-1]]][row] if len(row) else total[:-1]
                at, state = np.flatnonzero(code >= 0), None
                for j, step in enumerate(steps):
                    to = at + j
                    fits = to < len(code)
                    fits[fits] = (code[to[fits]] >= 0) & (row[to[fits]] == row[at[fits]])
                    at, to, state = at[fits], to[fits], 0 if state is None else state[fits]
                    key = state * len(known) + code[to]
                    state = np.minimum(np.searchsorted(step, key), len(step) - 1)
                    fits = step[state] == key
                    at, to, state = at[fits], to[fits], state[fits]
                    each = firsts[j][state + 1] - firsts[j][state]
                    if each.sum():
                        i = np.repeat(np.arange(len(at)), each)
                        which = pa.array(lasts[j][np.repeat(firsts[j][state] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())])
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[at[i]])), names.take(which), pa.array(before[at[i]]), pa.array(before[to[i]] + length[to[i]]), ambiguous.take(which)], ["id", "name", "start", "end", "ambiguous"])

    return texts.select("id", _pieces(F.col("low")).alias("pieces")).mapInArrow(run, f"id {dict(texts.dtypes)['id']}, name string, start long, end long, ambiguous boolean")


def _found_by_join(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, name, start, end, ambiguous) over (id, low): all runs of words as rows, joined to aliases (name, alias, ambiguous)."""
    a = aliases.withColumn("words", F.size(F.regexp_extract_all("alias", F.lit(WORD), F.lit(0))))
    sizes = [r["words"] for r in a.select("words").distinct().orderBy("words").collect()]  # how many words aliases have: few numbers
    d = texts.select("id", T.spans(F.col("low"), WORD).alias("w"), F.split("low", WORD, -1).alias("gap"))

    def runs(k: int) -> Column:
        """Runs of k words with what stands between them."""
        text = lambda i: F.array_join(F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda j: F.array(F.get("w", i + j)["s"], F.get("gap", i + j + 1)))), F.array(F.get("w", i + k - 1)["s"])), "")
        of = lambda x, i: F.struct(x["start"].alias("start"), F.get("w", i + k - 1)["end"].alias("end"), (x["s"] if k == 1 else text(i)).alias("alias"))
        return F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(0))), of)

    each = d.select("id", F.inline(F.concat(*[runs(k) for k in sizes])))
    return each.join(a, "alias").select("id", "name", "start", "end", "ambiguous")
