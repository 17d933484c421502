"""Text functions as column expressions: cleaning, tokens, languages, labels of times, snippets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.functions import vocab


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def worked_out(df: DataFrame) -> DataFrame:
    """df with its columns held by a generator: filters above don't go below it, where they would work costly columns out again."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def clean(c: Column) -> Column:
    """White space of any kind to single spaces, none at the ends; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def has_japanese(c: Column) -> Column:
    return c.rlike(f"[{vocab.JAPANESE}]")


def inferred_language(c: Column) -> Column:
    return F.when(has_japanese(c), "ja").otherwise("en")


def canonical_language(c: Column, known: tuple[str, ...] = ("ja", "en"), fallback: str = "en") -> Column:
    """Primary subtag, lower-cased, if known."""
    tag = F.split_part(F.lower(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit("-")))), F.lit("-"), F.lit(1))
    return F.when(tag.isin(*known), tag).otherwise(fallback)


def latin_tokens(c: Column) -> Column:
    """Runs of a-z, 0-9 and _ of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def running_totals(a: Column, chunk: int = 512) -> Column:
    """Of an array of longs, the sum before each element. In chunks: appending to one long array would copy it again and again."""
    zero = F.array(F.lit(0).cast("long"))
    fold = lambda xs, by: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + by(x))))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda i: fold(F.slice(a, i * chunk + 1, F.lit(chunk)), lambda x: x))
    whole = lambda ps: F.flatten(F.zip_with(ps, F.slice(fold(ps, lambda p: F.element_at(p, -1)), 1, F.size(ps)), lambda p, base: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + base)))
    return F.when(F.size(a) > 0, let(parts, whole)).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap, as (start, end, s): start and end in characters. What lies between them gives their places, so it is linear."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))

    def placed(x: Column) -> Column:
        steps = F.zip_with(lengths(x["m"]), lengths(x["b"]), lambda m, b: m + b)
        starts = F.zip_with(running_totals(steps), x["b"], lambda at, b: at + F.length(b))
        return F.zip_with(starts, x["m"], lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("s")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("b")), placed)


def bigrams(c: Column) -> Column:
    """Pairs of neighbouring characters; a single character is itself. The text is split once: linear in its length."""
    pairs = lambda x: F.when(F.size(x) < 2, F.filter(x, lambda y: y != "")).otherwise(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.concat(a, b)))
    return let(F.split(c, ""), pairs)


def lexical_tokens(text: Column, language: Column | None = None) -> Column:
    """Tokens for lexical search: with Japanese, bigrams without spaces and then the parts between spaces; else latin_tokens."""

    def of(low: Column) -> Column:
        japanese = has_japanese(low) if language is None else (F.coalesce(language, F.lit("")) == "ja") | has_japanese(low)
        parts = F.filter(F.split(low, " "), lambda x: x != "")
        return F.when(japanese, F.concat(bigrams(F.replace(low, F.lit(" "), F.lit(""))), parts)).otherwise(latin_tokens(low))

    return let(F.lower(clean(text)), of)


def routing_tokens(text: Column) -> Column:
    """The set of latin tokens and bigrams of CJK characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.concat(latin_tokens(low), bigrams(F.regexp_replace(low, r"[^\x{3040}-\x{30ff}\x{3400}-\x{9fff}]+", ""))))


def english_tokens(text: Column) -> Column:
    """Words without punctuation and stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+")
    stop = F.array(*[F.lit(w) for w in vocab.STOP_WORDS])
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def embed_text(raw: Column, tokens: Column) -> Column:
    """Raw text, a line feed and its tokens; '' without text."""
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "").otherwise(F.concat(raw, F.lit("\n"), F.array_join(tokens, " ")))


def query_rewrite(question: Column, language: Column | None = None) -> Column:
    """Keywords of a question; null if none are left or nothing changes."""
    q = F.coalesce(question, F.lit(""))
    original = F.lower(clean(q))
    japanese = has_japanese(q) if language is None else (F.coalesce(language, F.lit("")) == "ja") | has_japanese(q)
    ja = q
    for phrase in vocab.QUESTION_PHRASES:
        ja = F.replace(ja, F.lit(phrase), F.lit(" "))
    ja = clean(F.regexp_replace(ja, "[?？!！。、，,.]", " "))
    drop = F.array(*[F.lit(w) for w in vocab.QUESTION_WORDS])
    en = F.array_join(F.filter(latin_tokens(q), lambda w: ~F.array_contains(drop, w)), " ")
    new = F.when(japanese, ja).otherwise(en)
    return F.when((new == "") | (F.lower(clean(new)) == original) | (original == ""), None).otherwise(new)


def initial_tool(question: Column, language: Column | None = None) -> Column:
    """keyword_search for Japanese, quotes, digits and acronyms; else semantic_search."""
    q = F.coalesce(question, F.lit(""))
    exact = has_japanese(q) | q.rlike('["“”「」『』]') | q.rlike(r"\d") | q.rlike(r"(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])")
    if language is not None:
        exact = exact | (F.coalesce(language, F.lit("")) == "ja")
    return F.when(exact, "keyword_search").otherwise("semantic_search")


def token_estimate(text: Column, language: Column, cleaned: bool = False) -> Column:
    """Japanese: half the characters that aren't spaces; else words; else a quarter of the characters."""

    def of(t: Column) -> Column:
        half = F.ceil(F.length(F.replace(t, F.lit(" "), F.lit(""))) / 2.0)
        words = F.size(F.regexp_extract_all(t, F.lit(vocab.WORD), F.lit(0)))
        other = let(words, lambda n: F.when(n > 0, n.cast("long")).otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / 4.0))))
        return F.when(t == "", F.lit(0).cast("long")).when((F.coalesce(language, F.lit("")) == "ja") | has_japanese(t), F.greatest(F.lit(1), half)).otherwise(other)

    return let(text if cleaned else clean(text), of).cast("long")


def snippet(text: Column, most: int = 240) -> Column:
    return let(clean(text), lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))))


def clipped(text: Column, most: int) -> Column:
    """Cut at the last space before the limit, with three dots."""
    return let(clean(text), lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), r"\s\S*$", ""), F.lit("..."))))


def _hms(seconds: Column) -> tuple[Column, Column, Column]:
    s = F.floor(F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0)))).cast("long")
    return F.expr("1") * F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60


def hhmmss(seconds: Column) -> Column:
    h, m, s = _hms(seconds)
    return F.format_string("%02d:%02d:%02d", h, m, s)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    h, m, s = _hms(seconds)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def padded_clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on."""
    h, m, s = _hms(seconds)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def minutes_clock(seconds: Column) -> Column:
    h, m, s = _hms(seconds)
    return F.format_string("%d:%02d", h * 60 + m, s)


def clock_range(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit("-"), clock(F.greatest(F.coalesce(start, F.lit(0.0)), F.coalesce(end, F.lit(0.0)))))


def timed_url(url: Column, start: Column) -> Column:
    sep = F.when(F.instr(url, "?") > 0, "&").otherwise("?")
    return F.concat(url, sep, F.lit("t="), F.floor(F.greatest(start, F.lit(0.0))).cast("long").cast("string"), F.lit("s"))


def media_id(url: Column) -> Column:
    """An 11-character id from the usual URL forms, or bare."""
    found = [F.regexp_extract(url, p, 1) for p in (r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/(?:embed|shorts)/([A-Za-z0-9_-]{11})", r"^([A-Za-z0-9_-]{11})$")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def parsed_time(c: Column) -> Column:
    """ISO text to a timestamp in the session's zone (UTC); null where it can't be read."""
    return F.try_to_timestamp(c)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two arrays; 0 if one is empty."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def chunk_key(source: Column, index: Column, start: Column, end: Column) -> Column:
    """source:index, or source:start:end in milliseconds."""
    ms = lambda c: F.expr("cast(0 as bigint)") + F.floor(F.greatest(F.lit(0.0), c) * 1000).cast("long")
    return F.when(index.isNotNull(), F.concat_ws(":", source, index.cast("string"))).otherwise(F.concat_ws(":", source, ms(start).cast("string"), ms(end).cast("string")))


def query_hash(query: Column, mode: Column) -> Column:
    """16 hex digits of the SHA-256 of compact, key-sorted JSON of the normalised query and mode."""
    text = F.concat(F.lit('{"query":'), F.regexp_extract(F.to_json(F.struct(F.lower(clean(query)).alias("q"))), r'^\{"q":(.*)\}$', 1), F.lit(',"retrieval_mode":"'), mode, F.lit('"}'))
    return F.substring(F.sha2(text, 256), 1, 16)


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys: what fingerprints are taken of."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def recovered_json(text: str | None) -> object | None:
    """The JSON in a model's reply: a fenced block, the whole, or else the first balanced object or array that parses."""
    text = (text or "").strip()
    fenced = [b.split("\n", 1)[1] if "\n" in b else b for b in text.split("```")[1::2]]
    for candidate in [*fenced, text]:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    decoder = json.JSONDecoder()
    for at, c in enumerate(text):
        if c in "{[":
            try:
                return decoder.raw_decode(text[at:])[0]
            except ValueError:
                continue
    return None
