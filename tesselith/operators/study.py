"""Study material: evidence rows, rounds of review, sources of a topic, sentences, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators.speakers import attributed
from tesselith.operators.review import even_positions

# Kinds of cards, in turn; fillers that are no sentence; characters of a sentence at least, of a cut-off text, a cue, a question and an answer.
CARD_TYPES = ["recall", "concept", "detail", "application"]
FILLERS = ["はい", "うん", "ええ", "ああ", "そう", "そうですね", "えっと", "あの", "わあ", "へえ", "ほう"]
SENTENCE_CHARS, CLIP_CHARS, CUE_CHARS, QUESTION_CHARS, ANSWER_CHARS = 12, 260, 180, 220, 320


def search_tokens(text: Column) -> Column:
    """Latin words of three characters or more, runs of 2 to 12 kana and kanji, and single kanji, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9'_-]{2,}|[ぁ-んァ-ヴー一-龥]{2,12}|[一-龥]"), F.lit(0))
    return F.transform(found, F.lower)


def sentences(text: Column) -> Column:
    """Sentences that say something: no fillers, and 12 characters or more without commas and spaces; without one, the text cut at 260 characters."""

    def of(t: Column) -> Column:
        compact = lambda x: F.regexp_replace(x, r"[、,\s]+", "")
        parts = F.transform(F.split(t, r"[。.!?！？]\s*|\n+"), lambda x: F.regexp_replace(x, r"^[ 、,]+|[ 、,]+$", ""))
        fillers = F.array(*[F.lit(x) for x in FILLERS])
        good = F.filter(parts, lambda x: (x != "") & ~F.array_contains(fillers, compact(x)) & (F.length(compact(x)) >= SENTENCE_CHARS))
        head = F.substring(t, 1, CLIP_CHARS)
        cut = F.trim(F.regexp_replace(head, r" [^ ]*$", ""))
        rest = F.array(F.when(cut == "", F.trim(head)).otherwise(cut))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(T.let(good, lambda g: F.when(F.size(g) > 0, g).otherwise(rest)))

    return T.let(T.clean(text), of)


def evidence_rows(lines: DataFrame, limit: int, label: str = "segment") -> DataFrame:
    """(doc_id, evidence_id, ord, start_ds, end_ds, timestamp, text): up to `limit` readable lines of a document, evenly apart; one is the first.

    Ids carry the place among all lines, from 1.
    """
    rows = F.transform("lines", lambda x, i: F.struct(i.alias("ord"), x["start_ds"].alias("start_ds"), x["end_ds"].alias("end_ds"), T.clean(x["text"]).alias("text")))
    d = lines.select("doc_id", F.filter(rows, lambda x: x["text"] != "").alias("r"))
    at = F.when(F.lit(limit) <= 1, F.array(F.lit(0))).otherwise(even_positions(F.size("r"), F.lit(limit)))
    d = d.where("size(r) > 0").select("doc_id", F.explode(F.transform(at, lambda p: F.get("r", p))).alias("x"))
    return d.select("doc_id", F.concat(F.lit(label + "_"), (F.col("x.ord") + 1).cast("string")).alias("evidence_id"), F.col("x.ord").cast("long").alias("ord"), "x.start_ds", "x.end_ds", T.clock(F.col("x.start_ds") / 10.0).alias("timestamp"), "x.text")


def focused_evidence(sections: DataFrame, count: int) -> DataFrame:
    """(doc_id, place, evidence_id, section, text): the first concept of each section in turn, then the second of each, and so on.

    sections: (doc_id, section, title, concepts array<string>). Fewer than `count` are repeated as review rounds, with ids of their own.
    """
    concepts = F.filter(F.transform("concepts", T.clean), lambda x: x != "")
    d = sections.select("doc_id", "section", "title", F.posexplode(concepts).alias("point", "text"))
    w = Window.partitionBy("doc_id")
    d = d.withColumn("at", F.row_number().over(w.orderBy("point", "section")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("at") < count)
    base = F.concat(F.lit("section_"), (F.col("section") + 1).cast("string"), F.lit("_point_"), (F.col("point") + 1).cast("string"))
    d = d.select("doc_id", "section", base.alias("base"), F.concat("title", F.lit(": "), "text").alias("text"), F.explode(F.expr(f"sequence(at, {count - 1}, n)")).alias("place"), "n")
    turn = F.floor(F.col("place") / F.col("n"))
    name = F.when(turn == 0, F.col("base")).otherwise(F.concat("base", F.lit("_review_"), (turn + 1).cast("string")))
    return d.select("doc_id", F.col("place").cast("long").alias("place"), name.alias("evidence_id"), "section", T.clean(F.col("text")).alias("text"))


def topic_sources(topics: DataFrame, lines: DataFrame, limit: int = 5) -> DataFrame:
    """(doc_id, topic, ord, start_ds, timestamp, text): the lines that touch a topic's closed span, at most `limit`, evenly apart with the first and last.

    topics: (doc_id, topics array<struct<topic, start_ds, end_ds>>); both sides lie in a document's row, so nothing is compared across documents.
    """
    d = topics.join(lines, "doc_id").select("doc_id", "lines", F.explode("topics").alias("t"))
    rows = F.transform("lines", lambda x, i: F.struct(i.alias("ord"), x["start_ds"].alias("start_ds"), x["end_ds"].alias("end_ds"), T.clean(x["text"]).alias("text")))
    touching = F.filter(rows, lambda x: (x["end_ds"] >= F.col("t.start_ds")) & (x["start_ds"] <= F.col("t.end_ds")) & (x["text"] != ""))
    d = d.select("doc_id", F.col("t.topic").alias("topic"), touching.alias("r")).where("size(r) > 0")
    d = d.select("doc_id", "topic", F.explode(F.transform(even_positions(F.size("r"), F.lit(limit)), lambda p: F.get("r", p))).alias("x"))
    return d.select("doc_id", "topic", F.col("x.ord").cast("long").alias("ord"), "x.start_ds", T.clock(F.col("x.start_ds") / 10.0).alias("timestamp"), T.clipped(F.col("x.text"), 900).alias("text"))


def local_cards(evidence: DataFrame, count: int) -> DataFrame:
    """(doc_id, card, card_type, evidence_id, question, answer, source_cue): cards made of the first evidence rows, kinds in turn, without a model.

    evidence: (doc_id, evidence_id, place from 0, timestamp, text). The answer is the first sentence that says something.
    """
    d = evidence.where(F.col("place") < count)
    kinds = F.array(*[F.lit(x) for x in CARD_TYPES])
    kind = F.element_at(kinds, (F.col("place") % len(CARD_TYPES) + 1).cast("int"))
    ask = F.create_map(F.lit("recall"), F.lit("What is said at "), F.lit("concept"), F.lit("Which idea comes up at "), F.lit("detail"), F.lit("Which detail is given at "), F.lit("application"), F.lit("How would you explain what is said at "))
    return d.select("doc_id", (F.col("place") + 1).cast("long").alias("card"), kind.alias("card_type"), "evidence_id", F.concat(ask[kind], "timestamp", F.lit("?")).alias("question"), T.clipped(F.get(sentences(F.col("text")), F.lit(0)), 150).alias("answer"), T.clipped(F.col("text"), CUE_CHARS).alias("source_cue"))


def normalised_cards(raw: DataFrame, fallback: DataFrame, count: int) -> DataFrame:
    """(doc_id, card, card_type, question, answer, evidence_id, source_cue) of a model's cards, completed from the local ones.

    raw: (doc_id, card from 1, card_type, question, answer, evidence_id, source_cue); fallback: rows of local_cards. A card's evidence is the
    one it names, if the document has it, else that of the local card at its place, and round again; blank fields come from there too. With
    fewer cards than the lesser of `count` and the local ones, the local cards are the result.
    """
    cards = raw.where(F.col("card") <= count)
    n = fallback.groupBy("doc_id").agg(F.count(F.lit(1)).alias("local"))
    got = cards.groupBy("doc_id").agg(F.count(F.lit(1)).alias("given"))
    size = n.join(got, "doc_id", "left").select("doc_id", "local", (F.coalesce("given", F.lit(0)) < F.greatest(F.lit(1), F.least(F.lit(count), F.col("local")))).alias("few"))
    named = fallback.select("doc_id", F.col("evidence_id").alias("wanted"), F.col("source_cue").alias("its_cue"))
    f = fallback.select("doc_id", F.col("card").alias("at"), *[F.col(c).alias(f"f_{c}") for c in ("card_type", "question", "answer", "evidence_id", "source_cue")])
    blank = lambda c: F.nullif(T.clean(F.col(c)), F.lit(""))
    d = cards.join(size.where("not few"), "doc_id").withColumn("at", ((F.col("card") - 1) % F.col("local") + 1).cast("long")).withColumn("wanted", F.trim(F.coalesce("evidence_id", F.lit(""))))
    d = d.join(f, ["doc_id", "at"]).join(named, ["doc_id", "wanted"], "left")
    kind = F.lower(T.clean(F.col("card_type")))
    out = d.select(
        "doc_id", "card", F.when(kind.isin(*CARD_TYPES), kind).otherwise(F.col("f_card_type")).alias("card_type"), T.clipped(F.coalesce(blank("question"), "f_question"), QUESTION_CHARS).alias("question"),
        T.clipped(F.coalesce(blank("answer"), "f_answer"), ANSWER_CHARS).alias("answer"), F.when(F.col("its_cue").isNotNull(), F.col("wanted")).otherwise(F.col("f_evidence_id")).alias("evidence_id"),
        F.when(blank("source_cue").isNotNull(), T.clipped(F.col("source_cue"), CUE_CHARS)).otherwise(F.coalesce("its_cue", "f_source_cue")).alias("source_cue"),
    )
    instead = fallback.join(size.where("few").select("doc_id"), "doc_id", "left_semi").where(F.col("card") <= count)
    return out.unionByName(instead.select(*out.columns))


def marked_profiles(sections: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """(doc_id, section, section_type, confidence): the type with the most markers in the text, the first of equals; 'estimated' without any."""
    score = lambda words: sum((F.contains("text", F.lit(w)).cast("int") for w in words), F.lit(0))
    best = F.array_max(F.array(*[F.struct(score(ws).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(markers.items())]))
    d = sections.withColumn("__best", best)
    hit = F.col("__best.n") > 0
    return d.select("doc_id", "section", F.when(hit, F.col("__best.k")).otherwise("estimated").alias("section_type"), F.when(hit, "matched_markers").otherwise("estimated_keywords").alias("confidence"))


def summary_sections(items: DataFrame, lines: DataFrame, episodes: DataFrame) -> DataFrame:
    """Study sections of a cached summary: (doc_id, section, rank, title, tldr, key_points, anchor_text, start_ds, end_ds, evidence_ord, speaker, speaker_role, speaker_confidence).

    items: (doc_id, items array<struct<ord, rank, title, tldr, anchor, start_ds, end_ds>>); lines: (doc_id, lines); episodes: (doc_id, participants, primary_subject, role_claims). An item's
    evidence is the line that begins nearest to it, the first of equals; what an item lacks comes from there. Documents without lines have no sections. All within the row.
    """
    d = items.join(lines.select("doc_id", "lines"), "doc_id").join(episodes.select("doc_id", "participants", "primary_subject", "role_claims"), "doc_id", "left").where("size(lines) > 0")
    d = d.select("doc_id", "lines", "participants", "primary_subject", "role_claims", F.posexplode("items").alias("pos", "x"))
    start = F.coalesce("x.start_ds", F.lit(0).cast("long"))
    near = F.array_min(F.transform("lines", lambda line, i: F.struct(F.abs(line["start_ds"] - F.coalesce(F.col("x.start_ds"), F.lit(0).cast("long"))).alias("apart"), i.alias("i"))))
    d = d.withColumns({"section": F.col("pos") + 1, "evidence_ord": near["i"], "start_ds": start, "end_ds": F.coalesce("x.end_ds", start)})
    blank = lambda c: F.nullif(T.clean(c), F.lit(""))
    title = T.clipped(F.coalesce(blank(F.col("x.title")), F.concat(F.lit("Theme "), F.col("section").cast("string"))), 140)
    d = d.withColumns({"title": title, "tldr": T.clipped(F.col("x.tldr"), 600), "anchor_text": T.clipped(F.coalesce(blank(F.col("x.anchor")), F.get("lines", F.col("evidence_ord"))["text"]), 220), "rank": F.coalesce("x.rank", "section")})
    d = d.withColumns({"key_points": F.transform(F.slice(sentences(F.col("tldr")), 1, 4), lambda p: T.clipped(p, 180)), "value": T.clean(F.concat_ws(" ", "title", "tldr", "anchor_text"))})
    none = {"participants": "array<string>", "role_claims": "array<struct<name:string,role:string>>"}
    d = d.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})
    return attributed(d).select("doc_id", "section", "rank", "title", "tldr", "key_points", "anchor_text", "start_ds", "end_ds", "evidence_ord", "speaker", "speaker_role", "speaker_confidence")


def section_topics(sections: DataFrame) -> DataFrame:
    """Topics of sections as summary_sections() gives them, in their order: (doc_id, rank, title, tldr, key_points, anchor_text, start_ds, end_ds, timestamp, evidence_text)."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section"))
    d = sections.withColumn("place", place)
    text = F.coalesce(F.nullif("anchor_text", F.lit("")), F.nullif("tldr", F.lit("")), F.lit(""))
    return d.select("doc_id", F.col("place").alias("rank"), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Section "), F.col("place").cast("string"))).alias("title"), "tldr", "key_points", "anchor_text", "start_ds", "end_ds", T.clock(F.col("start_ds") / 10.0).alias("timestamp"), text.alias("evidence_text"))
