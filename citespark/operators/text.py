"""Text to terms: cleaning, tokens, stop words, lemmas, counts and vocabulary cuts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions import col_of, scalar_quantile, squish, top_per_group

# Common English function words; a fuller list can be passed as a table.
GENERAL_STOP_WORDS = """
a about above after again against all also an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers him his how i if
in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same
she should so some such than that the their theirs them then there these they this those through to too under until up
very was we were what when where which while who whom why will with would you your yours
""".split()

# Words that say nothing about the content of a scientific abstract.
OWN_STOP_WORDS = """
study paper result model approach article author method understand focus examine aim argue identify
increase datum potential explore include issue propose address apply require analyse relate finding
analyze discuss contribute publish involve draw lead exist set reduce create form explain play
affect regard associate establish follow conclude define strong attempt finally elsevier offer
taylor francis copyright springer wiley emerald
""".split()

STOP_WORDS = GENERAL_STOP_WORDS + OWN_STOP_WORDS

# Lemmas that override a dictionary.
OWN_LEMMAS = {
    "institutional": "institution", "technological": "technology", "national": "nation", "regional": "region",
    "sustainable": "sustainability", "environmental": "environment", "political": "policy",
}

GRAMS_AT_ONCE = 1_000_000  # n-grams that a task counts before it packs them

# Entities of trade marks and copyright signs.
MARK_ENTITIES = "&(trade|reg|copy|#8482|#174|#169);"


def compose_text(*columns: Column | str, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[col_of(c) for c in columns])


def clean_text(c: Column | str) -> Column:
    """Mark entities go, ``&`` becomes ``-and-``, white space is squished, broken tails are cut."""
    c = F.regexp_replace(col_of(c), MARK_ENTITIES, "")
    c = squish(F.replace(c, F.lit("&"), F.lit("-and-")))
    return F.regexp_replace(c, "�.*", "")


def tokenize(df: DataFrame, document: str, text: str, drop_numbers: bool = False, position: bool = False) -> DataFrame:
    """One row per lower-cased word, in any script; punctuation and symbols never become words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    if not position:
        # words are filtered one by one, in generated code, where no place depends on them
        rows = df.select(F.col(document).alias("document"), F.explode(words).alias("term")).where("term <> ''")
        return rows.where(~F.col("term").rlike(r"^\p{N}+$")) if drop_numbers else rows
    words = F.filter(words, lambda w: w != "")
    if drop_numbers:
        words = F.filter(words, lambda w: ~w.rlike(r"^\p{N}+$"))
    return df.select(F.col(document).alias("document"), F.posexplode(words).alias("pos", "term"))


def min_length_filter(tokens: DataFrame, longer_than: int = 2) -> DataFrame:
    return tokens.where(F.length("term") > longer_than)


def lemma_table(df: DataFrame, lemmas: Mapping[str, str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(lemmas.items()), "token string, lemma string")


def remove_stopwords(tokens: DataFrame, stop_words: DataFrame | Sequence[str] = STOP_WORDS) -> DataFrame:
    """Without the words of a table (anti-join) or of a list given in code (set look-up)."""
    if isinstance(stop_words, DataFrame):
        return tokens.join(stop_words.select(F.col("word").alias("term")), "term", "left_anti")
    return tokens.where(~F.col("term").isin(list(dict.fromkeys(stop_words))))


def lemmatize(tokens: DataFrame, dictionary: DataFrame | None = None, own: Mapping[str, str] = OWN_LEMMAS) -> DataFrame:
    """Dictionary replacement; own entries win, unknown words stay."""
    if dictionary is None:
        look = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
        return tokens.withColumn("term", F.coalesce(F.try_element_at(look, F.col("term")), F.col("term")))
    own_table = lemma_table(tokens, own)
    rest = dictionary.select("token", "lemma").join(own_table, "token", "left_anti")
    lemmas = own_table.unionByName(top_per_group(rest, ["token"], [F.col("lemma")], 1))
    out = tokens.join(lemmas.withColumnRenamed("token", "term"), "term", "left")
    return out.withColumn("term", F.coalesce("lemma", "term")).select(tokens.columns)


def term_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("document", "term").agg(F.count(F.lit(1)).alias("n"))


def text_tidy(
    df: DataFrame, document: str, text: str, stop_words: DataFrame | Sequence[str] = STOP_WORDS,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Counts per (document, term): clean, tokenise, drop short words, lemmatise, stop, count."""
    # nulls go before the cleaning, which else runs a second time inside the filter, in the tasks of the scan
    clean = df.select(document, text).dropna().select(document, clean_text(text).alias(text))
    tokens = min_length_filter(tokenize(clean, document, text))
    if dictionary is None and not isinstance(stop_words, DataFrame):
        # both word lists travel to the tasks: one shuffle in all
        return term_counts(remove_stopwords(lemmatize(tokens), stop_words))
    # large word tables are joined to counts, not to single tokens
    counts = remove_stopwords(lemmatize(term_counts(tokens), dictionary), stop_words)
    return counts.groupBy("document", "term").agg(F.sum("n").alias("n"))


def text_ngrams(df: DataFrame, document: str, text: str, n_max: int = 3, sep: str = "_") -> DataFrame:
    """(document, size, term): the 1- to n-grams of each text, cut from its array of words without a shuffle."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(w, n):
        starts = F.sequence(F.lit(1), F.size(w) - n + 1)
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.struct(
            F.lit(n).alias("size"), F.array_join(F.slice(w, i, F.lit(n)), sep).alias("term"))))

    # the outer lambda keeps the words, which Spark would else split anew for every n-gram
    made = F.transform(F.array(words), lambda w: F.flatten(F.array_compact(F.array(*[grams(w, n + 1) for n in range(n_max)]))))
    return df.select(F.col(document).alias("document"), F.explode_outer(made[0]).alias("_g")).select(
        "document", "_g.size", "_g.term").where(F.col("term").isNotNull())


def ngrams(tokens: DataFrame, n_max: int = 3, sep: str = "_") -> DataFrame:
    """1- to n-grams in token order, from ``(document, pos, term)``.

    Every token starts its n-grams with the tokens that follow it. Texts are handled word
    block by word block, so that a very long text is spread over many tasks.
    """
    block = 4096
    homes = F.array_distinct(F.transform(
        F.array(*[F.lit(i) for i in range(n_max)]),
        lambda k: F.floor((F.col("pos") - k) / block)))
    # the first words of a block also end the block before
    placed = tokens.select("document", "pos", "term", F.explode(homes).alias("_b")).where(F.col("_b") >= 0)
    w = Window.partitionBy("document", "_b").orderBy("pos")
    parts = [F.col("term")] + [F.lead("term", k).over(w) for k in range(1, n_max)]
    rows = placed.select("document", "pos", "_b", *[p.alias(f"_t{i}") for i, p in enumerate(parts)])
    rows = rows.where(F.floor(F.col("pos") / block) == F.col("_b"))
    grams = [
        F.struct(F.lit(k + 1).alias("size"), F.when(
            F.col(f"_t{k}").isNotNull(), F.concat_ws(sep, *[f"_t{i}" for i in range(k + 1)])).alias("term"))
        for k in range(n_max)
    ]
    out = rows.select("document", "pos", F.explode(F.array(*grams)).alias("_g"))
    return out.select("document", "pos", "_g.size", "_g.term").where(F.col("term").isNotNull())


def ngram_counts(grams: DataFrame, sep: str = "_") -> DataFrame:
    """(size, term, n): the rows of each n-gram of ``ngrams``, counted.

    Most n-grams are rare, so that counts made before a shuffle are nearly as many as the rows. They travel as compressed
    blocks in which the first two words stand once for all their n-grams, and are added up one bucket of words after the
    other: a task holds ``GRAMS_AT_ONCE`` rows, or those of one bucket.
    """
    partitions = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1024, 8 * partitions)

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codec, held = pa.Codec("zstd", 3), []

        def letters(x):
            x = x.cast(pa.large_binary())
            return np.frombuffer(x.buffers()[1], "i8")[x.offset:x.offset + len(x) + 1], x.buffers()[2] or pa.py_buffer(b"")

        def numbers(x):
            kind = np.min_scalar_type(x.max())  # the least one, as most numbers are small
            return kind.char.encode() + x.astype(kind).tobytes()

        def blocks():
            rows = pa.Table.from_batches(held).group_by(["h", "words", "tail", "size"], use_threads=False).aggregate([([], "count_all")])
            held.clear()
            rows = rows.take(pa.array(np.argsort(rows["h"].to_numpy().view("u8"), kind="stable"))).combine_chunks()
            words, tails = rows["words"].chunk(0), rows["tail"].chunk(0)
            h, size, n = rows["h"].to_numpy().view("u8"), rows["size"].to_numpy(), rows["count_all"].to_numpy()
            # in the order of the hashes equal words are neighbours, and buckets are ranges of hashes
            new = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
            bucket = ((h >> 32) * buckets >> 32).astype("i4")
            new |= np.diff(bucket, prepend=-1) != 0
            heads = np.flatnonzero(new)
            (of_tails, tail), (of_words, word) = letters(tails), letters(words.take(pa.array(heads)))
            starts, made = np.flatnonzero(np.diff(bucket, prepend=-1)), []
            firsts = np.searchsorted(heads, [*starts, len(h)])
            for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(h)])):
                a, b = firsts[k], firsts[k + 1]
                raw = b"".join([
                    *map(numbers, (n[i:j], size[i:j], np.diff(of_tails[i:j + 1]), np.diff(heads[a:b], append=j), np.diff(of_words[a:b + 1]))),
                    tail[int(of_tails[i]):int(of_tails[j])].to_pybytes(), word[int(of_words[a]):int(of_words[b])].to_pybytes()])
                made.append((int(bucket[i]), int(j - i), int(b - a), len(raw), codec.compress(raw, asbytes=True)))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made), (*[pa.int32()] * 3, pa.int64(), pa.binary()))],
                                   names=["bucket", "rows", "heads", "bytes", "block"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= GRAMS_AT_ONCE:
                yield blocks()
        if sum(map(len, held)):
            yield blocks()

    def added(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codec, held, last = pa.Codec("zstd", 3), [], None

        def unpacked(rows, heads, size, block):
            raw, at = codec.decompress(block, size, asbytes=True), 0

            def numbers(n):
                nonlocal at
                out = np.frombuffer(raw, chr(raw[at]), n, at + 1)
                at += 1 + out.nbytes
                return out

            def texts(sizes):
                nonlocal at
                ends = np.concatenate([[0], np.cumsum(sizes, dtype="i8")])
                out = pa.Array.from_buffers(pa.large_utf8(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(raw[at:at + ends[-1]])])
                at += int(ends[-1])
                return out

            n, sizes, of_tails, of_heads, of_words = map(numbers, (rows, rows, rows, heads, heads))
            tails, words = texts(of_tails), texts(of_words)
            terms = pc.binary_join_element_wise(words.take(pa.array(np.repeat(np.arange(heads), of_heads))), tails, pa.scalar("", pa.large_utf8()))
            return pa.table([pa.array(sizes.astype("i4")), terms, pa.array(n.astype("i8"))], names=["size", "term", "n"])

        def summed():
            rows = pa.concat_tables(held).group_by(["size", "term"], use_threads=False).aggregate([("n", "sum")])
            rows = rows.select(["size", "term", "n_sum"]).rename_columns(["size", "term", "n"])
            held.clear()
            yield from rows.cast(pa.schema([("size", pa.int32()), ("term", pa.string()), ("n", pa.int64())])).to_batches(100_000)

        for batch in batches:
            for bucket, *block in zip(*(batch.column(x).to_pylist() for x in ("bucket", "rows", "heads", "bytes", "block"))):
                if held and bucket != last:
                    yield from summed()
                last = bucket
                held.append(unpacked(*block))
        if held:
            yield from summed()

    words = F.substring_index("term", sep, 2)
    rows = grams.select(F.xxhash64(words).alias("h"), words.alias("words"), F.substr("term", F.length(words) + 1).alias("tail"), "size")
    blocks = rows.mapInArrow(counted, "bucket int, rows int, heads int, bytes bigint, block binary")
    return blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(added, "size int, term string, n bigint")


# vocabulary cuts -------------------------------------------------------------------
SENT_SHARE = 0.001  # terms of a larger share of the documents are so few that they are sent to all tasks


def remove_sparse_terms(counts: DataFrame, sparse: float = 0.99) -> DataFrame:
    """Terms in more than ``N (1 - sparse)`` of the N documents."""
    n = counts.select("document").distinct().agg(F.count(F.lit(1))).scalar()
    # rounded, so that 1 - 0.99 is 0.01
    share = round(1 - sparse, 12)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") > n * F.lit(share))
    kept = df.select("term")
    if share >= SENT_SHARE:
        # at most 1 / share times the mean number of terms of a document, however many documents: the counts stay where they are
        kept = F.broadcast(kept)
    return counts.join(kept, "term", "left_semi")


def trim_by_frequency_quantile(counts: DataFrame, p: float = 0.90) -> DataFrame:
    """Terms whose total frequency reaches the p-quantile of all term totals."""
    tf = counts.groupBy("term").agg(F.sum("n").alias("tf"))
    keep = tf.where(F.col("tf") >= scalar_quantile(tf, "tf", p))
    return counts.join(keep.select("term"), "term", "left_semi")


def min_tokens_per_doc(counts: DataFrame, n: int = 2) -> DataFrame:
    keep = counts.groupBy("document").agg(F.sum("n").alias("_n")).where(F.col("_n") >= n)
    return counts.join(keep.select("document"), "document", "left_semi")


def top_features(counts: DataFrame, n: int = 500) -> DataFrame:
    tf = counts.groupBy("term").agg(F.sum("n").alias("freq"))
    return tf.orderBy(F.desc("freq"), "term").limit(n)


def corpus_clean(df: DataFrame, text: str) -> DataFrame:
    """Squish white space, strip punctuation, lower."""
    c = F.regexp_replace(squish(F.col(text)), r"\p{P}+", "")
    return df.withColumn(text, F.lower(c))


def stem_complete(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace each word by the most frequent full word of its stem, ``stems(term, stem)`` given."""
    counts = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(stems, "term")
    best = top_per_group(counts, ["stem"], [F.desc("n"), F.col("term")], 1)
    best = best.select("stem", F.col("term").alias("full"))
    look = stems.join(best, "stem").select("term", "full")
    return tokens.join(look, "term", "left").withColumn("term", F.coalesce("full", "term")).select(tokens.columns)


