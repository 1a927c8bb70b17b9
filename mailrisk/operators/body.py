"""Layer 3: text signals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from mailrisk.functions import exprs, grams
from mailrisk.operators import logistic, ngrams
from mailrisk.operators.signals import emit
from mailrisk.operators.skew import SMALL_ROWS, lookup_join
from mailrisk.schemas import MIN_TOKENS
from mailrisk.session import bound_batches, bound_reads, cut_lineage, is_small

# A sentence ends at closing punctuation followed by space, or at a line break.
# A run of punctuation is tried once, from its start.
SENTENCE_END = "(?<![.!?])[.!?]++(?:[ \\t\\r\\n]+|$)|[\\r\\n]+"


def zero_width_signals(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """zero_width: invisible characters in the subject or body."""
    count = lambda c: F.regexp_count(F.col(c), F.lit(exprs.ZERO_WIDTH))
    counted = messages.select(key, (count("subject") + count("body_text")).alias("found"))
    return emit(
        counted.where(F.col("found") > 0),
        "zero_width",
        F.format_string("%d zero-width character(s) in subject or body", "found"),
        key=key,
        count=F.col("found"),
    )


# --- urgency -----------------------------------------------------------------


def char_grams(text: Column, n: int) -> Column:
    """All runs of n characters, in one pass: a match of no length at every character."""
    return F.regexp_extract_all(
        text, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1)
    )


def gram_columns(df: DataFrame, text_col: str) -> DataFrame:
    """Add `words` and `chars`, the character 3-, 4- and 5-grams of a text."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn("words", exprs.word_tokens(text)).withColumn(
        "chars", F.concat(*[char_grams(text, n) for n in (3, 4, 5)])
    )


def term_counts(df: DataFrame, text_col: str, features: int) -> DataFrame:
    """Add `tf`: counts of words, word pairs and character 3-5-grams, hashed to 2 * features columns.

    The two kinds are told apart by a letter in front. Each text is read once and its terms are hashed
    where they stand (`grams`); null counts as empty. Vectors take some ten times their text, and are made
    and handed on a few texts at a time.
    """
    kept = df.drop("tf")
    bound_reads(df.sparkSession)
    return _with_terms(kept, text_col, [StructField("tf", VectorUDT())], lambda texts: [grams.sparse_vectors(texts, 2 * features)])


def _with_terms(df: DataFrame, text_col: str, added: list[StructField], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df and the columns that `make` gives for its lower-case texts, a few at a time."""
    names = df.columns
    bound_batches(df.sparkSession)
    lowered = df.withColumn("_lowered", F.lower(F.coalesce(F.col(text_col), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grams.parts(batch, len(names)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column(len(names)))], names=[*names, *[f.name for f in added]])

    return lowered.mapInArrow(run, StructType([*df.schema.fields, *added]))


def urgency_features(df: DataFrame, text_col: str = "text", features: int = 1 << 18) -> DataFrame:
    """Feature vectors of a corpus, weighted by document frequency in that corpus.

    The texts are read twice: to count in how many each column occurs, and to make the vectors, which are not written.
    """
    width = 2 * features

    def having(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(width + 1)
        for batch in batches:
            for part in grams.parts(batch, 0):
                found = grams.batch_counts([t.as_py() or "" for t in part.column(0)], width)
                out[:-1] += np.bincount(np.concatenate([c for c, _ in found]), minlength=width)
                out[-1] += len(found)
        return out

    bound_batches(df.sparkSession)
    found = logistic.total(df.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_lowered")), having)
    if len(found) == 1 or not found[-1]:
        raise ValueError("there is no text")
    idf = df.sparkSession.sparkContext.broadcast(logistic.inverse_frequencies(found[-1], found[:-1]))
    return _with_terms(df, text_col, [StructField("features", VectorUDT())], lambda texts: [grams.sparse_vectors(texts, width, idf.value)])


def count_entries(df: DataFrame, key: str, vector_col: str = "features") -> DataFrame:
    """(key, entries): entries of sparse vectors above zero, without the zeros between them; null for a null vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pc.struct_field(batch.column(1), "values")
            before = np.r_[0, np.cumsum(values.values.to_numpy() > 0)][values.offsets.to_numpy()]
            found = pc.if_else(values.is_valid(), pa.array(np.diff(before), pa.int32()), pa.scalar(None, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "entries"])

    source = df.select(key, vector_col)
    return source.mapInArrow(run, StructType([source.schema[key], StructField("entries", IntegerType())]))


def fit_urgency(
    train: DataFrame, text_col: str = "text", label_col: str = "label",
    features: int = 1 << 18, max_iter: int = 20,
) -> logistic.TermModel:
    """Fit the urgency classifier on labelled mail. Term counts are written once, packed; fitting reads them several times."""
    labelled = train.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("double").alias("label"), F.col(text_col).alias("_text")
    )
    fields = [StructField(c, BinaryType()) for c in ("low", "high", "times")]
    bound_reads(train.sparkSession)
    terms = cut_lineage(_with_terms(labelled, "_text", fields, lambda texts: grams.packed(texts, 2 * features)).drop("_text"))
    return logistic.fit(terms, 2 * features, max_iter)


def score_urgency(model: logistic.TermModel | PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `urgency`, the probability that a text presses the reader. Each text is scored where it is read; no vectors are made.

    A pipeline of the library's IDF and logistic regression over `term_counts` scores as well.
    """
    if isinstance(model, PipelineModel):
        idf, last = model.stages[-2:]
        model = logistic.TermModel(idf.idf.toArray() * last.coefficients.toArray(), last.intercept)
    shared = df.sparkSession.sparkContext.broadcast(model)
    return _with_terms(df.drop("urgency"), text_col, [StructField("urgency", DoubleType())], lambda texts: [
        pa.array(shared.value.probabilities([t.as_py() or "" for t in texts]))])


def heldout_accuracy(scored: DataFrame, label_col: str = "label") -> float:
    """Share of held-out rows that the classifier puts on the right side of one half."""
    judged = scored.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("double").alias("label"),
        (F.col("urgency") >= 0.5).cast("double").alias("prediction"),
    )
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(judged)


def urgency_signals(scored: DataFrame, threshold: float = 0.5, key: str = "message_id") -> DataFrame:
    return emit(
        scored.where(F.col("urgency") >= threshold),
        "urgency",
        F.format_string("urgency classifier gives %.3f", "urgency"),
        F.col("urgency"),
        key=key,
    )


# --- language model ----------------------------------------------------------


def token_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """counts(token, n) over whole texts."""
    return (
        df.select(F.explode(exprs.word_tokens(F.col(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def sentence_words(messages: DataFrame, text_col: str, *keys: str, max_tokens: int | None = None) -> DataFrame:
    """(keys, sentence, _words): the words of each sentence, of the first max_tokens words of a text if that is given."""
    words_of = F.transform(F.split(F.col(text_col), SENTENCE_END), exprs.word_tokens)
    if max_tokens is not None:
        words_of = _first_tokens(words_of, max_tokens)
    return messages.select(*keys, F.posexplode(words_of).alias("sentence", "_words"))


def fit_ngram_lm(corpus: DataFrame, text_col: str = "text", order: int = 1, discount: float = ngrams.DISCOUNT) -> DataFrame:
    """Model of a reference corpus: lm(token, nll), and one row (NULL, nll) for the unseen.

    nll is the negative natural logarithm of a smoothed probability: of order 1 an add-one model of
    words, of order 2 an interpolated Kneser-Ney model of word pairs within sentences (`ngrams`).
    The counts are written once; the model itself is made of them.
    """
    if order == 2:
        pairs = ngrams.sentence_pairs(sentence_words(corpus, text_col))
        return ngrams.fit(cut_lineage(ngrams.pair_counts(pairs)), discount, written=True)
    if order != 1:
        raise ValueError("orders are 1 and 2")
    counts = cut_lineage(token_counts(corpus, text_col))
    size = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    mass = float((size["total"] or 0) + size["kinds"]) or 1.0
    seen = counts.select("token", (-F.log((F.col("n") + 1) / mass)).alias("nll"))
    unseen = corpus.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("token"), F.lit(math.log(mass)).alias("nll")
    )
    return seen.unionByName(unseen)


# A model of at most this many words is broadcast; a larger one is joined by word.
MAX_BROADCAST_WORDS = 1_000_000
# Of a larger model, so many frequent words of so many bytes at most are broadcast.
FREQUENT_WORDS, FREQUENT_BYTES = 500_000, 100
# Words that are looked up in a broadcast at once.
WORDS_AT_ONCE = 200_000


def sentence_scores(
    messages: DataFrame,
    lm: DataFrame,
    text_col: str = "body_text",
    key: str = "message_id",
    max_tokens: int | None = None,
    broadcast_words: int = MAX_BROADCAST_WORDS,
    order: int = 1,
) -> DataFrame:
    """sentence_scores(key, sentence, tokens, nll): mean nll of each sentence with a word.

    Whole texts are scored; max_tokens limits a message to its first tokens, as a
    model with a fixed context would. While the model is small its words are looked
    up where the text is, and a sentence is scored there. Of a model of more
    words or bytes the frequent words are looked up so; only the other words, and the sums of
    sentences that have any, are shuffled. So are those of messages whose key repeats: their sentences are one.
    `order` is that of the model; of order 2, each kind of pair in these texts is scored once and then looked up.
    """
    texts, repeats = _with_repeats(messages, key, text_col)
    spoken = sentence_words(texts, text_col, key, "_again", max_tokens=max_tokens)
    if order == 2:
        spoken = spoken.withColumn("_words", ngrams.pair_names(F.col("_words")))
        model = ngrams.pair_nll(ngrams.name_counts(spoken), lm).withColumn("_weight", F.log("n"))
        unseen = 0.0
    else:
        unseen = lm.where(F.col("token").isNull()).first()["nll"]
        model = lm.where(F.col("token").isNotNull()).withColumn("_weight", -F.col("nll"))
    small = is_small(model.select("token", "nll"), broadcast_words, written=True)
    often = F.lit(True) if small else _is_frequent(model, min(broadcast_words, FREQUENT_WORDS))
    scored = _looked_up(spoken, model.where(often).select("token", "nll").toArrow(), unseen if small else None)
    whole = ~F.col("_again") & (F.size("_rare") == 0)
    done = scored.where(whole).select(key, "sentence", "tokens", "nll")
    if small and not repeats:
        return done.withColumn("nll", F.col("nll") / F.col("tokens"))
    others = cut_lineage(scored.where(~whole).drop("_again"))
    asked = others.select(key, "sentence", F.explode("_rare").alias("token"))
    if small:
        rare = asked.withColumn("nll", F.lit(None).cast("double"))
    else:
        seldom = model.where(~often)
        counts = seldom.select("token", "n") if order == 2 else None
        rare = lookup_join(asked, seldom.select("token", "nll"), "token", broadcast_words, counts, True)
    sums = others.select(key, "sentence", "tokens", "nll").unionByName(
        rare.select(key, "sentence", F.lit(0).cast("bigint").alias("tokens"), F.coalesce("nll", F.lit(unseen)).alias("nll")))
    summed = sums.groupBy(key, "sentence").agg(F.sum("tokens").alias("tokens"), F.sum("nll").alias("nll"))
    return done.unionByName(summed).withColumn("nll", F.col("nll") / F.col("tokens"))


def _with_repeats(messages: DataFrame, key: str, text_col: str) -> tuple[DataFrame, bool]:
    """(key, text, _again): whether another message has the key too, said of all where very many do; and whether any has."""
    kept = messages.select(key, text_col)
    repeated = cut_lineage(kept.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), F.lit(True).alias("_found")))
    if repeated.isEmpty():
        return kept.withColumn("_again", F.lit(False)), False
    if not is_small(repeated, SMALL_ROWS):
        return kept.withColumn("_again", F.lit(True)), True
    same = F.col(key).eqNullSafe(F.col("_key"))
    marked = kept.join(F.broadcast(repeated), same, "left")
    return marked.select(key, text_col, F.coalesce("_found", F.lit(False)).alias("_again")), True


def _is_frequent(model: DataFrame, most: int) -> Column:
    """Whether a word of model(token, nll, _weight) is among those with the largest weights, `most` at most: those above a level."""
    short = F.octet_length("token") <= FREQUENT_BYTES
    level_of = F.floor(F.col("_weight") * 16)
    sizes = model.where(short & level_of.isNotNull()).groupBy(level_of.alias("_level")).agg(F.count("*").alias("n"))
    chosen, level = 0, None
    for row in sizes.orderBy(F.desc("_level")).limit(4096).collect():
        chosen += row["n"]
        if chosen > most:
            break
        level = row["_level"]
    return F.lit(False) if level is None else F.coalesce(short & (level_of >= level), F.lit(False))


def _looked_up(spoken: DataFrame, known: pa.Table, unseen: float | None) -> DataFrame:
    """spoken(..., _words) to (..., tokens, nll, _rare): the sum of nll over the words in known(token, nll), and the others.

    `unseen`, if given, is the nll of the others, which are none then. Sentences without a word are left out.
    """
    names = [c for c in spoken.columns if c != "_words"]
    kinds = {f.name: f for f in spoken.schema.fields}
    schema = StructType([*[kinds[c] for c in names], StructField("tokens", LongType()), StructField("nll", DoubleType()),
                         StructField("_rare", ArrayType(StringType()))])
    known = known.combine_chunks()
    tokens = known.column("token").cast(pa.string()).to_pylist()
    values = np.r_[known.column("nll").to_numpy(), 0.0 if unseen is None else unseen].astype(np.float64)
    if unseen is not None:
        values[np.isnan(values)] = unseen
    shared = spoken.sparkSession.sparkContext.broadcast((pa.array(tokens, pa.string()), values))
    most = WORDS_AT_ONCE

    def scored(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        table = table.filter(pc.greater(pc.list_value_length(table.column("_words")), 0))
        words = pa.concat_arrays(table.column("_words").chunks) if table.num_rows else pa.array([], pa.list_(pa.string()))
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten().cast(pa.string())
        held, nll = shared.value
        at = pc.fill_null(pc.index_in(flat, value_set=held), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # -1 is the last value: that of words that are not known.
        sums = np.bincount(row, weights=nll[at], minlength=len(sizes))
        rare = (at < 0) if unseen is None else np.zeros(len(at), bool)
        ends = np.r_[0, np.cumsum(np.bincount(row[rare], minlength=len(sizes)))].astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(rare)))
        columns = [table.column(c).combine_chunks() for c in names]
        columns = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(sums), others], names=[*names, "tokens", "nll", "_rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("_words").flatten())
            if size >= most:
                yield scored(held)
                held, size = [], 0
        if held:
            yield scored(held)

    return spoken.mapInArrow(run, schema)


def _first_tokens(words: Column, max_tokens: int) -> Column:
    """Word arrays of sentences, cut after max_tokens words in all."""
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<array<string>>").alias("kept"))
    return F.aggregate(
        words,
        empty,
        lambda acc, w: F.when(acc["used"] >= max_tokens, acc).otherwise(
            F.struct(
                F.least(acc["used"] + F.size(w), F.lit(max_tokens)).alias("used"),
                F.concat(
                    acc["kept"], F.array(F.slice(w, F.lit(1), F.lit(max_tokens) - acc["used"]))
                ).alias("kept"),
            )
        ),
        lambda acc: acc["kept"],
    )


def text_shape(scores: DataFrame, messages: DataFrame, key: str = "message_id") -> DataFrame:
    """Per message: tokens, perplexity (mean nll), and the spread of its sentences."""
    shape = scores.groupBy(key).agg(
        F.sum("tokens").alias("tokens"),
        (F.sum(F.col("nll") * F.col("tokens")) / F.sum("tokens")).alias("perplexity"),
        F.stddev_samp("nll").alias("nll_spread"),
        F.stddev_samp("tokens").alias("length_spread"),
        F.count("*").alias("sentences"),
    )
    return messages.select(key).join(shape, key, "left").withColumn(
        "tokens", F.coalesce("tokens", F.lit(0))
    )


def _too_short(min_tokens: int) -> Column:
    return F.when(F.col("tokens") < min_tokens, F.lit("body too short"))


def perplexity_signals(
    shape: DataFrame, suspect_below: float = 6.0, min_tokens: int = MIN_TOKENS, key: str = "message_id"
) -> DataFrame:
    """perplexity: text that the model finds unusually easy. Short bodies abstain."""
    short = _too_short(min_tokens)
    return emit(
        shape.where(short.isNotNull() | (F.col("perplexity") < suspect_below)),
        "perplexity",
        F.format_string("mean negative log-likelihood %.3f over %d tokens", "perplexity", "tokens"),
        error=short,
        key=key,
        tokens=F.col("tokens"),
    )


def burstiness_signals(
    shape: DataFrame, suspect_below: float = 0.5, min_tokens: int = MIN_TOKENS, key: str = "message_id"
) -> DataFrame:
    """burstiness: sentences that hardly differ. Abstains on short bodies and single sentences."""
    reason = F.coalesce(
        _too_short(min_tokens), F.when(F.col("nll_spread").isNull(), F.lit("fewer than two sentences"))
    )
    return emit(
        shape.where(reason.isNotNull() | (F.col("nll_spread") < suspect_below)),
        "burstiness",
        F.format_string(
            "sentence spread %.3f in likelihood, %.3f in length", "nll_spread", "length_spread"
        ),
        error=reason,
        key=key,
        sentences=F.col("sentences"),
    )


# --- fusion ------------------------------------------------------------------

FUSION_FEATURES = ("zero_width", "urgency", "perplexity", "burstiness")


def fit_fusion(
    features: DataFrame, label_col: str = "label", max_iter: int = 50
) -> tuple[PipelineModel, DataFrame]:
    """Logistic regression over the four text features; also coefficients(feature, coefficient).

    Rows in which a feature abstained (NULL) are left out.
    """
    rows = features.dropna(subset=[*FUSION_FEATURES, label_col]).withColumn(
        "label", F.col(label_col).cast("double")
    )
    stages = [
        VectorAssembler(inputCols=list(FUSION_FEATURES), outputCol="features"),
        LogisticRegression(maxIter=max_iter, featuresCol="features", labelCol="label"),
    ]
    model = Pipeline(stages=stages).fit(rows)
    fitted = model.stages[-1]
    named = [*zip(FUSION_FEATURES, fitted.coefficients.toArray().tolist()), ("intercept", fitted.intercept)]
    coefficients = features.sparkSession.createDataFrame(named, "feature string, coefficient double")
    return model, coefficients


def fusion_signals(
    model: PipelineModel, features: DataFrame, threshold: float = 0.5, key: str = "message_id"
) -> DataFrame:
    """fusion: combined probability; abstains where one of the features did."""
    complete = features.dropna(subset=list(FUSION_FEATURES))
    scored = model.transform(complete).select(
        key, F.get(vector_to_array("probability"), F.lit(1)).alias("fused")
    )
    absent = [F.when(F.col(f).isNull(), F.lit(f)) for f in FUSION_FEATURES]
    partial = features.withColumn("absent", F.array_compact(F.array(*absent))).where(F.size("absent") > 0)
    fired = emit(
        scored.where(F.col("fused") >= threshold),
        "fusion",
        F.format_string("text features combine to %.3f", "fused"),
        F.col("fused"),
        key=key,
    )
    abstained = emit(
        partial,
        "fusion",
        F.lit(""),
        error=F.concat(F.lit("no value for "), F.array_join("absent", ", ")),
        key=key,
    )
    return fired.unionByName(abstained)
