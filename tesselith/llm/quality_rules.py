"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame operations only.

Every text gets counts; their ratios go into KLL sketches, one per language and source. Sketches merge, so a
language's and the whole corpus's come from those of the groups, not from the rows. A document fails where a ratio lies
outside fences drawn from its group's quartiles. A group's quartiles are drawn towards its language's, and those towards all documents', the more the
fewer documents it has, by a weight that is smooth in their number. What chance does in a short text is allowed for: a fence is wider by
some standard errors of a mean of so few words, and a few symbols, lines or words are no ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import written

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Documents of its language that a group's quartiles are mixed with, and of all that a language's are.
PRIOR = 20
#: Fences lie so many spreads (upper minus lower quartile) beyond the quartiles, and the room besides.
QUANTILES, SPREADS = (0.25, 0.75), 3.0
#: Ratios, with the room beyond the spreads and the sides on which a fence stands.
RATIOS = {
    "mean_word": (0.5, "both"),
    "symbol_ratio": (0.01, "upper"),
    "dup_line_ratio": (0.1, "upper"),
    "repeat_ratio": (0.1, "upper"),
}
#: Standard errors by which the fences of a text's mean word widen, for words of this standard deviation; symbols, lines and words (a window and one more) that are no ratio yet.
ERRORS, WORD_SD = 4.0, 2.5
FREE = {"n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 6}
#: At this size a KLL sketch's ranks are within one percent.
SKETCH_K = 400

_SPACES = "' \\t\\n\\u000B\\f\\r'"
_SYMBOLS = "#*$%&|<>"


def counts(text: Column) -> dict[str, Column]:
    """Counts of a text; null counts as empty. Words are runs of characters other than space and tab to carriage return."""
    t = F.coalesce(text, F.lit(""))
    spaced = F.translate(t, "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " ", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return {
        "words": words,
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0].cast("long"),
    }


def repeat_words(words: str, window: int = WINDOW) -> str:
    """SQL: words in windows of `window` words found twice or more, first included.

    Windows are 64-bit hashes. Only texts with an equal pair go on: positions are sorted by hash, those with an equal
    neighbour kept in order of place, and each covers `window` words less what the next one covers too.
    """
    hashes = f"transform(sequence(0, size(h) - {window}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(window))}))"
    return f"""
      if(size({words}) < {window}, 0L,
        transform(array(transform({words}, w -> xxhash64(w))), h ->
          transform(array({hashes}), g ->
            if(size(array_distinct(g)) = size(g), 0L,
              transform(array(array_sort(transform(g, (v, i) -> named_struct('v', v, 'i', i)))), s ->
                transform(array(sort_array(transform(filter(sequence(0, size(s) - 1),
                    k -> (k > 0 and s[greatest(k - 1, 0)].v = s[k].v) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].v = s[k].v)), k -> s[k].i))), p ->
                  aggregate(sequence(0, size(p) - 1), 0L,
                    (acc, k) -> acc + if(k = size(p) - 1, {window}, least({window}, p[least(k + 1, size(p) - 1)] - p[k]))))[0])[0]))[0])[0])
    """


def features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs and its counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), named with the prefix."""
    c = counts(F.col(text_col))
    d = docs.withColumn("__tl_words", c.pop("words"))
    d = d.withColumns({f"{prefix}n_words": F.size("__tl_words").cast("long"), **{f"{prefix}{k}": v for k, v in c.items()}, f"{prefix}n_repeat_words": F.expr(repeat_words("__tl_words"))})
    return d.drop("__tl_words")


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def ratios(prefix: str = "") -> dict[str, Column]:
    """The ratios that fences hold; a text without words has ratio 0."""
    c = lambda k: F.greatest(F.lit(0.0), F.col(f"{prefix}{k}").cast("double") - FREE.get(k, 0))
    words = F.greatest(c("n_words"), F.lit(1.0))
    return {
        "mean_word": c("word_chars") / words,
        "symbol_ratio": c("n_symbols") / F.greatest(c("word_chars"), F.lit(1.0)),
        "dup_line_ratio": c("n_dup_lines") / (c("n_dup_lines") + words / 12.0),
        "repeat_ratio": c("n_repeat_words") / words,
    }


def allowance(ratio: str, prefix: str = "") -> Column:
    """By how much a text's fences are wider than its group's."""
    words = F.greatest(F.col(f"{prefix}n_words").cast("double"), F.lit(1.0))
    return ERRORS * WORD_SD / F.sqrt(words) if ratio == "mean_word" else F.lit(0.0)


def _quartiles(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, number of documents, and for each ratio an array of the quartiles; null without documents."""
    out = [F.col("n").alias(f"n_{name}")]
    for r in RATIOS:
        out.append(F.when(F.col("n") > 0, F.array(*[F.expr(f"kll_sketch_get_quantile_double(s_{r}, {q}D)") for q in QUANTILES])).alias(f"{name}_{r}"))
    return sketches.select(*keys, *out)


def thresholds(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "", prior: int = PRIOR) -> DataFrame:
    """(lang_key, source_key, fences): a row per language and source. Documents that the base rules fail don't count.

    Keys are '' for null and '=' and the value otherwise. Sketches draw at random: write the result before it is used twice.
    """
    key = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    # no filter: it would be pushed below the counts and work them out twice; sketches skip nulls
    rows = measured.select(key(lang_col).alias("lang_key"), key(source_col).alias("source_key"), *[F.when(~base_failed(prefix), v).alias(k) for k, v in ratios(prefix).items()])
    group = rows.groupBy("lang_key", "source_key").agg(F.count("mean_word").alias("n"), *[F.expr(f"kll_sketch_agg_double({r}, {SKETCH_K})").alias(f"s_{r}") for r in RATIOS])
    merged = [F.sum("n").alias("n"), *[F.expr(f"kll_merge_agg_double(s_{r}, {SKETCH_K})").alias(f"s_{r}") for r in RATIOS]]
    language = _quartiles(group.groupBy("lang_key").agg(*merged), ["lang_key"], "lang")
    # one row
    everything = _quartiles(group.withColumn("one", F.lit(0)).groupBy("one").agg(*merged), ["one"], "all")
    d = _quartiles(group, ["lang_key", "source_key"], "group").join(language, "lang_key").withColumn("one", F.lit(0)).join(F.broadcast(everything), "one")

    def mixed(r: str, i: int) -> Column:
        at = lambda name: F.col(f"{name}_{r}")[i]
        share = lambda name: F.col(f"n_{name}") / (F.col(f"n_{name}") + F.lit(float(prior)))
        language = F.coalesce(share("lang") * at("lang") + (1 - share("lang")) * at("all"), at("all"))
        return F.coalesce(share("group") * at("group") + (1 - share("group")) * language, language)

    out = []
    for r, (room, side) in RATIOS.items():
        lo, hi = mixed(r, 0), mixed(r, 1)
        reach = SPREADS * (hi - lo) + room
        out.append(F.array(lo - reach if side == "both" else F.lit(float("-inf")), hi + reach).alias(r))
    return d.select("lang_key", "source_key", F.struct(*out).alias("fences"))


def verdict(measured: DataFrame, fences: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "") -> DataFrame:
    """measured with base_failed and kept (both with the prefix). Without any document that passes the base rules there are no fences."""
    key = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    f = fences.select(F.col("lang_key").alias("__tl_l"), F.col("source_key").alias("__tl_s"), F.col("fences").alias("__tl_f"))
    d = measured.withColumns({"__tl_lk": key(lang_col), "__tl_sk": key(source_col)})
    d = d.join(f, (F.col("__tl_lk") == F.col("__tl_l")) & (F.col("__tl_sk") == F.col("__tl_s")), "left")
    inside = F.lit(True)
    for r, v in ratios(prefix).items():
        lo, hi = (F.col("__tl_f").getField(r).getItem(i) for i in (0, 1))
        inside = inside & (v >= lo - allowance(r, prefix)) & (v <= hi + allowance(r, prefix))
    d = d.withColumn(f"{prefix}base_failed", base_failed(prefix))
    d = d.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.coalesce(inside, F.lit(True)))
    return d.drop("__tl_l", "__tl_s", "__tl_f", "__tl_lk", "__tl_sk")


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Null languages and sources are groups of their own. Equal rows are each
    rated. The counts are written once to the shared folder; sketches and filter read them, not the texts. Only the four
    columns are read. Without rows the result is empty.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = written(features(narrow).drop("text"), "quality-counts")
    return verdict(measured, written(thresholds(measured, **options), "quality-fences")).drop("lang", "source")


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that are kept, all their columns. Texts are neither shuffled nor written: a second scan counts again and filters."""
    narrow = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    fences = written(thresholds(features(narrow).drop("text"), **options), "quality-fences")
    # held by a generator: the filter would go below the counts and work them out again
    d = features(docs, text_col, "__tl_")
    d = d.select(F.inline(F.array(F.struct(*d.columns))))
    return verdict(d, fences, lang_col, source_col, "__tl_").where("__tl_kept").select(*docs.columns)
