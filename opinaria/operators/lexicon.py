"""Lexicon sentiment scores (the VADER rules of Hutto & Gilbert 2014, as adapted to Portuguese).

Plan: tokens are cut inside the row; every worker has the lexicon as arrays and finds the valences of a text where the text is
(``known_words``), so nothing is shuffled. Rows that share an id count as one text; these, and all rows where workers cannot read the
shared folder or a word has several measures, go through joins: tokens are zipped with their three left neighbours, a table of hash
buckets, bounded in size, drops nearly all that the lexicon cannot know before anything is exploded, and the hits are shuffled by document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from opinaria.functions.tokens import round_exact
from opinaria.functions.translit import strip_accents_ascii
from opinaria.operators.known_words import MOST_PHRASE_WORDS, hit_rows, sum_rows
from opinaria.session import computed, cut_lineage, fits_broadcast, let, lookup, shared_dir, sized, worker_path

# The scorer's weights and the punctuation it strips from a word.
CAPS = 0.733
NEGATED = -0.74
DAMPING = (1.0, 0.95, 0.9)
NEVER_SO = 1.25
BANG, QUESTION, QUESTION_MAX = 0.292, 0.18, 0.96
ALPHA = 15
PUNCTUATION = (".", "!", "?", ",", ";", ":", "-", "'", '"', "...", "!?", "?!", "!!", "!!!",
               "??", "???", "?!?", "!?!", "?!?!", "!?!?")
NEVER, SO, WITHOUT, DOUBT = "nunca", ("entao", "este"), "sem", "dúvida"
CONTRAST = ("mas",)
ALL_CONTRASTS = ("mas", "entretanto", "todavia", "porem", "porém")

_ITEMS = "|".join(sorted(("".join("\\" + c for c in p) for p in PUNCTUATION), key=lambda p: -len(p)))
# Possessive core and look-aheads: a plain word is rejected without backtracking.
_CORE = r"([^\p{Punct}\s]{2,}+)"
STRIP_ONE = rf"^(?:(?=\p{{Punct}})(?:{_ITEMS}){_CORE}|{_CORE}(?=\p{{Punct}})(?:{_ITEMS}))$"


@dataclass(frozen=True)
class Rules:
    """Words steering the scorer. ``contrast_by_value`` re-weights the running list of valences by
    looking every one up by value, which the reference does; without it each valence is
    halved before the first contrast word and raised by half after it."""

    contrast: Sequence[str] = CONTRAST
    contrast_by_value: bool = True
    emoji_before_folding: bool = False


def scorer_text(text: Column) -> Column:
    return strip_accents_ascii(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Whitespace tokens of two or more characters, less one leading or trailing mark."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 1),
                       lambda w: F.regexp_replace(w, STRIP_ONE, "$1$2"))


def is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def partly_upper(words: Column) -> Column:
    """Some but not all words are upper case."""
    n = F.size(F.filter(words, is_upper))
    return (n > 0) & (n < F.size(words))


def punctuation_emphasis(text: Column) -> Column:
    bangs = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    asks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.least(bangs, F.lit(4)) * BANG + (
        F.when(asks > 3, QUESTION_MAX).when(asks > 1, asks * QUESTION).otherwise(0.0))


def word_table(lexicon: DataFrame, boosters: DataFrame, negations: DataFrame) -> DataFrame:
    """One row per word: valence if the lexicon has it, booster strength, negation mark."""
    single = boosters.filter(~F.contains("phrase", F.lit(" "))).select(F.col("phrase").alias("key"), "boost")
    no = negations.filter(~F.contains("phrase", F.lit(" "))).select(F.col("phrase").alias("key"), F.lit(True).alias("negates"))
    return (lexicon.select(F.col("word").alias("key"), "measure")
            .join(single.dropDuplicates(["key"]), "key", "full")
            .join(no.dropDuplicates(["key"]), "key", "full"))


def replace_emoji(df: DataFrame, emoji: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Whitespace tokens that are emoji (or emoticons) become their description."""
    rows = df.select(id_col, F.posexplode_outer(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
                     .alias("pos", "emoji"))
    named = lookup(rows, emoji, "emoji", salt=F.col(id_col))
    return named.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("description", "emoji").alias("word"))))),
        lambda t: t["word"]), " ").alias(text))


# Hash buckets of the words a scorer knows, one byte each; a larger lexicon fills the table and lets more words through to the join.
KNOWN_BUCKETS = 1 << 18


def bucket_test(words: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for every word of a table, and for few others while the table is small beside ``KNOWN_BUCKETS``."""
    def bucket_of(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(KNOWN_BUCKETS)).cast("int")

    # The buckets come to the driver as a few bitmaps, not as a row each: a full table is 32 KB. Spark numbers bits from 1.
    place = (bucket_of(F.col(column)) + 1).cast("bigint")
    maps = words.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    flags = np.zeros(KNOWN_BUCKETS, dtype=np.uint8)
    for row in maps:
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), bitorder="little")
        start = (row["n"] - 1) * len(bits)
        flags[start:start + len(bits)] = bits[:KNOWN_BUCKETS - start]
    known, yes = F.lit(bytearray(flags.tobytes())), F.lit(bytearray([1]))
    return lambda word: F.substring(known, bucket_of(word) + 1, F.lit(1)) == yes


def _neighbourhood(words: Column, lowered: Column, upper: Column) -> Column:
    """One struct per word with its position, the three words before it, lower-cased, and whether those are upper
    case; first of all a mark (position -1) that keeps wordless documents in the result. The neighbours
    are the same arrays zipped with a shift, so no word is looked up or folded again."""
    no_word, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def shifted(values: Column, none: Column, by: int) -> Column:
        return F.concat(F.array(*[none] * by), values)

    zipped = F.arrays_zip(F.sequence(F.lit(-1), F.size(words) - 1).alias("pos"), shifted(words, no_word, 1).alias("word"), shifted(lowered, no_word, 1).alias("key"),
                          *[shifted(lowered, no_word, d + 1).alias(f"k{d}") for d in (1, 2, 3)],
                          *[shifted(upper, no_flag, d + 1).alias(f"u{d}") for d in (1, 2, 3)])
    return F.slice(zipped, F.lit(1), F.size(words) + 1)


def _steps(valence: Column, row) -> Column:
    """Valence after the modifiers at distance 1, 2 and 3; a neighbour the lexicon knows is skipped."""
    pos = row("pos")
    so = [F.coalesce(row(f"k{d}").isin(*SO), F.lit(False)) for d in (1, 2, 3)]
    doubt = [F.coalesce(row(f"k{d}") == DOUBT, F.lit(False)) for d in (1, 2, 3)]

    def apply(v: Column, d: int) -> Column:
        sign = F.when(v < 0, -1.0).otherwise(1.0)
        caps = F.when(row(f"u{d}") & row("mixed_caps"), F.when(v > 0, CAPS).otherwise(-CAPS)).otherwise(0.0)
        moved = v + F.coalesce(row(f"b{d}") * sign + caps, F.lit(0.0)) * DAMPING[d - 1]

        def negate(m: Column) -> Column:
            plain = F.when(row(f"n{d}"), m * NEGATED).otherwise(m)
            never = F.coalesce(row(f"k{d}") == NEVER, F.lit(False))
            without = F.coalesce(row(f"k{d}") == WITHOUT, F.lit(False))
            if d == 1:
                return plain
            if d == 2:
                return F.when(never & so[0], m * NEVER_SO).when(without & doubt[0], m).otherwise(plain)
            # the word right before counts on its own here
            return (F.when((never & so[1]) | so[0], m * NEVER_SO)
                    .when(without & (doubt[1] | doubt[0]), m).otherwise(plain))

        out = let(moved, negate)
        if d == 3:
            out = out + F.coalesce(row("phrase_boost"), F.lit(0.0))
        return F.when((pos >= d) & ~row(f"known{d}"), out).otherwise(v)

    def step(d: int):
        return lambda v: apply(v, d)

    out = valence
    for d in (1, 2, 3):
        out = let(out, step(d))
    return out


def contrast_plain(pos: Column, valence: Column, at: Column) -> Column:
    return F.when(pos < at, valence * 0.5).when(pos > at, valence * 1.5).otherwise(valence)


def scaled_by_value(values: Sequence[float], factors: Sequence[float]) -> list[float]:
    """One pass over the values: each step scales, by its own factor, the first entry equal to the entry the step stands on, so equal
    values are scaled at the first of them. Every distinct value has a queue of the places that hold it, so a step costs the logarithm of a
    queue; places whose value has changed since leave a queue when they come to its front."""
    state = list(values)
    places: dict[float, list[int]] = {}
    for k, x in enumerate(state):
        places.setdefault(x, []).append(k)
    for k in range(len(state)):
        x = state[k]
        queue = places[x]
        while state[queue[0]] != x:
            heappop(queue)
        first = queue[0]
        moved = x * factors[first]
        if moved != x:
            heappop(queue)
            state[first] = moved
            heappush(places.setdefault(moved, []), first)
    return state


@F.pandas_udf(ArrayType(DoubleType()))
def _scaled_rows(values: pd.Series, positions: pd.Series, at: pd.Series) -> pd.Series:
    out = []
    for v, p, a in zip(values, positions, at):
        if len(v) == 0:
            out.append(v)
        else:
            out.append(scaled_by_value(v.tolist(), np.select([p < a, p > a], [0.5, 1.5], 1.0).tolist()))
    return pd.Series(out)


def contrast_by_value(values: Column, positions: Column, at: Column) -> Column:
    """``scaled_by_value`` of each row's valences in text order: halved before the contrast word, raised by half after it."""
    return _scaled_rows(values, positions, F.coalesce(at, F.lit(-1)))


DOC = ("emphasis", "n_words", "contrast_at")
# Words and phrases, and their bytes, up to which every worker holds a lexicon.
WORKER_ROWS, WORKER_BYTES = 8_000_000, 256_000_000


def _read(df: DataFrame, id_col: str, text: str, rules: Rules, emoji: DataFrame | None) -> DataFrame:
    """Words, lower-cased words, capitals, emphasis and contrast word of every text."""
    docs = df.select(id_col, F.col(text).alias("_text"))
    if emoji is not None and rules.emoji_before_folding:
        docs = replace_emoji(docs, emoji, id_col, "_text")
    docs = computed(docs, _text=scorer_text(F.col("_text")))
    if emoji is not None and not rules.emoji_before_folding:
        docs = replace_emoji(docs, emoji, id_col, "_text")

    docs = computed(docs, _words=tokens(F.col("_text")), emphasis=punctuation_emphasis(F.col("_text"))).drop("_text")
    docs = computed(docs, _lower=F.transform("_words", lambda w: F.lower(w)), _upper=F.transform("_words", is_upper))
    n_upper = F.size(F.filter("_upper", lambda u: u))
    # the first listed contrast word that occurs decides; its first position counts
    at = F.coalesce(*[F.nullif(F.array_position("_lower", F.lit(c)), F.lit(0)) for c in rules.contrast]) \
        if rules.contrast else F.lit(None).cast("bigint")
    return docs.select("*", F.size("_words").alias("n_words"), ((n_upper > 0) & (n_upper < F.size("_words"))).alias("mixed_caps"),
                       (at - 1).cast("int").alias("contrast_at"))


@dataclass(frozen=True)
class _Lists:
    """Written words and phrases of a scorer; ``paths`` where workers can read them whole."""

    words: DataFrame
    phrases: DataFrame
    paths: tuple[str, str] | None


def _lists(lexicon: DataFrame, boosters: DataFrame, negations: DataFrame) -> _Lists:
    spark, tables, paths = lexicon.sparkSession, [], []
    for rows in (word_table(lexicon, boosters, negations), boosters.filter(F.contains("phrase", F.lit(" "))).dropDuplicates(["phrase"])):
        path = shared_dir(spark)
        rows.write.parquet(path)
        tables.append(spark.read.schema(rows.schema).parquet(path))
        paths.append(worker_path(spark, path))
    words, phrases = tables
    parts = F.split("phrase", " ")
    known = words.agg(F.count("key").alias("n"), F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0)).alias("held"),
                      F.bool_or(F.isnan("measure")).alias("odd")).first()
    said = phrases.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("phrase") + 32), F.lit(0)).alias("held"), F.max(F.size(parts)).alias("longest")).first()
    usable = None not in paths and known["n"] + said["n"] <= WORKER_ROWS and known["held"] + said["held"] <= WORKER_BYTES and not known["odd"]
    if usable and (said["longest"] or 0) > 2:
        usable = phrases.select(F.explode(parts)).distinct().count() <= MOST_PHRASE_WORDS
    if usable:  # a word with several measures is several rows of a join
        usable = words.filter("key IS NOT NULL").groupBy("key").count().filter("count > 1").isEmpty()
    return _Lists(words, phrases, tuple(paths) if usable else None)


def _once_and_again(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id no other row has, and the others, if there are any."""
    again = cut_lineage(df.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_again"))
    if again.isEmpty():
        return df, None
    again = sized(again)
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def _rules() -> dict:
    return {"special": [NEVER, WITHOUT, DOUBT, *SO], "caps": CAPS, "damping": DAMPING, "negated": NEGATED, "never_so": NEVER_SO}


def _schema(docs: DataFrame, carry: Sequence[str], **more: DataType) -> StructType:
    return StructType([*[docs.schema[c] for c in carry], *[StructField(name, kind) for name, kind in more.items()]])


def token_valences(df: DataFrame, lexicon: DataFrame, boosters: DataFrame, negations: DataFrame,
                   id_col: str = "doc_id", text: str = "text", rules: Rules = Rules(),
                   emoji: DataFrame | None = None) -> DataFrame:
    """One row per lexicon hit (and one mark row, position -1, per document) with its valence
    after capitals, modifiers, negation and multi-word boosters, before contrast."""
    lists = _lists(lexicon, boosters, negations)
    if lists.paths is None:
        return _joined_valences(df, lists, id_col, text, rules, emoji)
    once, again = _once_and_again(df, id_col)
    docs, carry = _read(once, id_col, text, rules, emoji), [id_col, *DOC]
    kinds = {"_pos": ArrayType(IntegerType()), "_word": ArrayType(StringType()), "_valence": ArrayType(DoubleType())}
    found = docs.select(*carry, "mixed_caps", "_words", "_lower", "_upper").mapInArrow(
        hit_rows(lists.paths, carry, _rules()), _schema(docs, carry, **kinds))
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("valence")))
    rows = F.arrays_zip(F.col("_pos").alias("pos"), F.col("_word").alias("word"), F.col("_valence").alias("valence"))
    out = found.select(*carry, F.inline(F.concat(mark, rows)))
    return out if again is None else out.unionByName(_joined_valences(again, lists, id_col, text, rules, emoji))


def _joined_valences(df: DataFrame, lists: _Lists, id_col: str, text: str, rules: Rules, emoji: DataFrame | None) -> DataFrame:
    docs, table = _read(df, id_col, text, rules, emoji), lists.words
    small = fits_broadcast(table)
    may_be_known = bucket_test(table.filter(F.col("measure").isNotNull() & F.col("boost").isNull()), "key")
    near_hits = F.filter(_neighbourhood(F.col("_words"), F.col("_lower"), F.col("_upper")), lambda x: (x["pos"] < 0) | may_be_known(x["key"]))
    docs = computed(docs, _w=near_hits)
    rows = docs.select(id_col, "emphasis", "n_words", "mixed_caps", "contrast_at", F.inline("_w"))

    hits = lookup(rows, table.select("key", "measure", "boost"), "key", salt=F.col(id_col), bounded=small)
    hits = hits.filter((F.col("pos") < 0) | (F.col("measure").isNotNull() & F.col("boost").isNull())).drop("boost")

    # A repeated word takes the neighbours of its first occurrence.
    hits = hits.repartition(id_col)
    first = W.partitionBy(id_col, "word").orderBy("pos")
    near = F.first(F.struct("pos", "k1", "k2", "k3", "u1", "u2", "u3")).over(first)
    hits = hits.select(id_col, "emphasis", "n_words", "mixed_caps", "contrast_at", "word", "measure",
                       F.col("pos").alias("at"), near.alias("_n")).select(
        id_col, "emphasis", "n_words", "mixed_caps", "contrast_at", "word", "measure", "at", "_n.*")

    for d in (1, 2, 3):
        side = table.select(F.col("key").alias(f"k{d}"), F.col("measure").isNotNull().alias(f"known{d}"),
                            F.col("boost").alias(f"b{d}"), F.coalesce("negates", F.lit(False)).alias(f"n{d}"))
        hits = lookup(hits, side, f"k{d}", salt=F.col("at"), bounded=small)
    phrases = lists.phrases
    few = fits_broadcast(phrases)
    grams = {"p321": ("k3", "k2", "k1"), "p32": ("k3", "k2"), "p21": ("k2", "k1")}
    for name, keys in grams.items():
        hits = hits.withColumn(name, F.concat_ws(" ", *keys))
        hits = lookup(hits, phrases.select(F.col("phrase").alias(name), F.col("boost").alias(f"_{name}")),
                      name, salt=F.col("at"), bounded=few)
    zero = F.lit(0.0)
    hits = hits.withColumn("phrase_boost", F.coalesce("_p321", zero) + F.coalesce("_p32", zero) + F.coalesce("_p21", zero))
    for d in (1, 2, 3):
        hits = hits.withColumn(f"known{d}", F.coalesce(f"known{d}", F.lit(False))) \
                   .withColumn(f"n{d}", F.coalesce(f"n{d}", F.lit(False)))

    own_caps = F.when(is_upper(F.col("word")) & F.col("mixed_caps"),
                      F.when(F.col("measure") > 0, CAPS).otherwise(-CAPS)).otherwise(0.0)
    valence = _steps(F.col("measure") + own_caps, F.col)
    hits = computed(hits, valence=F.when(F.col("at") >= 0, valence))
    return hits.select(id_col, "emphasis", "n_words", "contrast_at", F.col("at").alias("pos"), "word", "valence")


def scores(valences: DataFrame, id_col: str = "doc_id", rules: Rules = Rules()) -> DataFrame:
    """Document scores from :func:`token_valences`: compound and the shares of positive,
    negative and neutral words, unrounded and rounded."""
    v, doc = F.col("valence"), ["emphasis", "n_words", "contrast_at"]
    if rules.contrast_by_value:
        # Only documents with a contrast word need their valences in order; all others sum.
        hits = F.collect_list(F.when(v.isNotNull() & F.col("contrast_at").isNotNull(), F.struct("pos", v.alias("v"))))
        plain = [F.sum(F.when(F.col("contrast_at").isNull(), v)).alias("s0"),
                 *[F.sum(F.when(F.col("contrast_at").isNull(), x)).alias(n) for n, x in _parts(v).items()]]
        grouped = valences.groupBy(id_col, *doc).agg(F.array_sort(hits).alias("_h"), *plain)
        lists = computed(grouped, _v=F.transform("_h", lambda x: x["v"]), _p=F.transform("_h", lambda x: x["pos"]))
        folded = lists.withColumn("_f", contrast_by_value(F.col("_v"), F.col("_p"), F.col("contrast_at")))

        def total(part) -> Column:
            return F.aggregate("_f", F.lit(0.0), lambda a, x: a + part(x))
        rows = folded.select(
            id_col, *doc,
            (F.coalesce("s0", F.lit(0.0)) + total(lambda x: x)).alias("s"),
            *[(F.coalesce(n, F.lit(0.0)) + total(_part(n))).alias(n) for n in ("p", "n", "hit")])
    else:
        w = F.when(F.col("contrast_at").isNull(), v).otherwise(contrast_plain(F.col("pos"), v, F.col("contrast_at")))
        rows = valences.withColumn("_v", w).groupBy(id_col, *doc).agg(
            F.coalesce(F.sum("_v"), F.lit(0.0)).alias("s"),
            *[F.coalesce(F.sum(x), F.lit(0.0)).alias(n) for n, x in _parts(F.col("_v")).items()])
    return _finish(rows, id_col)


def _parts(v: Column) -> dict[str, Column]:
    """Positive and negative mass (each word also counts one) and the number of non-neutral words."""
    return {"p": F.when(v > 0, v + 1).otherwise(0.0), "n": F.when(v < 0, v - 1).otherwise(0.0),
            "hit": F.when(v != 0, 1.0).otherwise(0.0)}


def _part(name: str):
    return lambda v: _parts(v)[name]


def _finish(rows: DataFrame, id_col: str) -> DataFrame:
    emphasis, s = F.col("emphasis"), F.col("s")
    total = s + F.when(s > 0, emphasis).when(s < 0, -emphasis).otherwise(0.0)
    rows = rows.withColumn("_t", total)
    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_t") / F.sqrt(F.col("_t") * F.col("_t") + ALPHA)))
    pos = F.when(F.col("p") > -F.col("n"), F.col("p") + emphasis).otherwise(F.col("p"))
    neg = F.when(F.col("p") < -F.col("n"), F.col("n") - emphasis).otherwise(F.col("n"))
    rows = rows.select(id_col, "n_words", compound.alias("raw_compound"), pos.alias("_p"), F.abs(neg).alias("_n"),
                       (F.col("n_words") - F.col("hit")).alias("_z"))
    mass = F.col("_p") + F.col("_n") + F.col("_z")

    def share(part: str) -> Column:
        return F.when(mass > 0, F.col(part) / mass).otherwise(0.0)

    rows = rows.select(id_col, "raw_compound", share("_p").alias("raw_pos"), share("_n").alias("raw_neg"),
                       share("_z").alias("raw_neu"))
    return rows.select("*", round_exact(F.col("raw_compound"), 4).alias("compound"),
                       *[round_exact(F.col(f"raw_{n}"), 3).alias(n) for n in ("pos", "neg", "neu")])


def score_sentiment(df: DataFrame, lexicon: DataFrame, boosters: DataFrame, negations: DataFrame,
                    id_col: str = "doc_id", text: str = "text", rules: Rules = Rules(),
                    emoji: DataFrame | None = None) -> DataFrame:
    """``scores`` of the ``token_valences`` of every document, added up where its text is."""
    lists = _lists(lexicon, boosters, negations)
    if lists.paths is None:
        return scores(_joined_valences(df, lists, id_col, text, rules, emoji), id_col, rules)
    once, again = _once_and_again(df, id_col)
    docs, carry = _read(once, id_col, text, rules, emoji), [id_col, *DOC]
    sums = docs.select(*carry, "mixed_caps", "_words", "_lower", "_upper").mapInArrow(
        sum_rows(lists.paths, carry, _rules(), scaled_by_value if rules.contrast_by_value else None),
        _schema(docs, carry, **{name: DoubleType() for name in ("s", "p", "n", "hit")}))
    out = _finish(sums, id_col)
    return out if again is None else out.unionByName(scores(_joined_valences(again, lists, id_col, text, rules, emoji), id_col, rules))


def lexicon_label(compound: Column) -> Column:
    """Neutral text counts as positive."""
    return F.when(compound >= 0, "positive").otherwise("negative")
