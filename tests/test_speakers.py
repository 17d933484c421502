"""People in titles and texts, by hand-made cases."""

import random
import re

from tesselith.operators import speakers


def test_episode_context(spark):
    rows = [
        (1, "The Stephen Curry Interview | Mind the Game | LeBron James and Steve Nash", "進撃の役者役の田中太郎 が語る。刑事役の山田花子 刑事役の山田花子"), (2, "夜の対談 出演：田中太郎、山田 花子／  佐藤", None),
        (3, "An evening | ESPN | Anna O'Neil with Bo Li, Carl Max Ray & NBA", ""), (4, None, "x"), (5, "plain", "no roles"), (6, "出演：" + "、".join(f"人{i}" for i in range(20)), "y"),
    ]
    got = {r.id: r for r in speakers.episode_context(spark.createDataFrame(rows, "id long, title string, intro string")).collect()}
    assert got[1].primary_subject == "Stephen Curry" and got[1].participants == ["Stephen Curry", "LeBron James", "Steve Nash"]
    assert [(c.name, c.role) for c in got[1].role_claims] == [("田中太郎", "進撃の役者"), ("山田花子", "刑事")]
    assert got[2].cast_names == ["田中太郎", "山田 花子", "佐藤"] == got[2].participants and got[2].role_claims == []
    assert got[3].participants == ["Anna O'Neil", "Bo Li", "Carl Max Ray"] and got[3].primary_subject == ""
    assert got[4].participants == got[5].participants == [] and len(got[6].cast_names) == 8


def test_speakers(spark):
    two, claims = ["Stephen Curry", "LeBron James"], [("LeBron James", "host")]
    rows = [
        ("Curry explains the play", two, "Curry"), ("STEPHEN CURRY, of all people, describes it", two, "Stephen Curry"), ("Curry explains how LeBron James changed", two, None), ("Curry. He explains", two, None),
        ("James tells a story", two, "LeBron James"), ("Currys explain", two, None), ("Curry in a conversation", two, "Multiple"), ("nobody here", two, None), (None, two, None), ("Curry " + "x" * 60 + " explains", two, None),
        ("田中太郎 が語る", ["田中太郎"], "田中太郎"), ("Li says so", ["Bo Li"], None), ("Bo Li says so", ["Bo Li"], "Bo Li"), ("The A+B (x) talk", ["A+B (x)"], None), ("Curry says", ["Stephen Curry", "Seth Curry"], None),
    ]
    d = spark.createDataFrame([(i, v, p, "Stephen Curry", claims) for i, (v, p, _) in enumerate(rows)], "id long, value string, participants array<string>, primary_subject string, role_claims array<struct<name:string,role:string>>")
    got = {r.id: r for r in speakers.attributed(d).collect()}
    for i, (_, _, want) in enumerate(rows):
        if want is None:
            assert got[i].speaker_confidence == "unattributed", rows[i]
        elif want == "Multiple":
            assert (got[i].speaker, got[i].speaker_role, got[i].speaker_confidence) == ("Multiple speakers", "Stephen Curry, LeBron James", "episode_context")
        else:
            assert want in got[i].speaker and got[i].speaker_confidence == "named_in_section"
    assert (got[0].speaker_role, got[4].speaker_role, got[10].speaker_role) == ("interview subject", "host", "participant")


def test_mentions_against_regular_expressions(spark):
    r = random.Random(2)
    words = ["Anna", "O'Neil", "Bo", "Li", "Curry", "curry", "Ray", "Carl", "Max", "größe", "-", "O", "Neil", "Anna-Li", "CURRY's"]
    texts = [(i, r.choice([" ", "  ", ", "]).join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "Bo Li")]
    names = ["Anna O'Neil", "Bo Li", "Stephen Curry", "Seth Curry", "Carl Max Ray", "Größe", "-", "", "Carl  Max Ray"]
    clean = sorted({re.sub(r"\s+", " ", n).strip() for n in names} - {"", "-"})
    goes_by = {n: [n.lower()] + ([t[-1].lower()] if len(t := re.findall(r"[A-Za-z][A-Za-z'’-]+", n)) >= 2 and len(t[-1]) >= 4 else []) for n in clean}
    want = set()
    for i, text in texts:
        for n, als in goes_by.items():
            ends = {}
            for a in als:
                for m in re.finditer(rf"(?=\b({re.escape(a)})\b)", (text or "").lower()):
                    e, shared = m.end(1), sum(a in x for x in goes_by.values()) > 1
                    old = ends.get(e, (m.start(1), True))
                    ends[e] = (min(old[0], m.start(1)), old[1] and shared)
            want |= {(i, n, s, e, amb) for e, (s, amb) in ends.items()}
    d = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = [tuple(x) for x in speakers.mentions(d, spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(x[4] for x in want)
    assert speakers.mentions(d, spark.createDataFrame([], "name string")).count() == 0


def test_mentions_make_no_rows_of_words(spark):
    names = spark.createDataFrame([("Anna O'Neil",), ("Bo  Li",), ("Seth Curry",), ("Stephen Curry",)], "name string")
    texts = spark.createDataFrame([(1, "Anna O'NEIL, anna o neil; Bo Li Li."), (2, None), (3, "curry größe Seth Curry"), (4, "Bo Li"), (5, "Li")], "id long, text string")
    few = speakers.mentions(texts, names)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # not a row for each word of a text
    want = {(1, "Anna O'Neil", 0, 11, False), (1, "Bo Li", 26, 31, False), (3, "Seth Curry", 0, 5, True), (3, "Stephen Curry", 0, 5, True), (3, "Seth Curry", 12, 22, False), (3, "Stephen Curry", 17, 22, True), (4, "Bo Li", 0, 5, False)}
    assert {tuple(r) for r in few.collect()} == want
    held, speakers.FEW = speakers.FEW, 1
    try:
        assert {tuple(r) for r in speakers.mentions(texts, names).collect()} == want
    finally:
        speakers.FEW = held
    assert speakers.mentions(texts, names.where("false")).collect() == []
