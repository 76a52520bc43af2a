"""Line-first quality rules: judge every line, take failing lines out, then judge what the document has lost.

Line rules: (1) punctuation: a longer line needs sentence punctuation and may not be made of signs; (2) navigation: bars
and arrows between short labels, bare links; (3) boilerplate: fixed phrases of licences, cookies, copyright where they are
a quarter of the words or the line is short and no sentence; shouting; stuttered words; repeats of an earlier line. A document stays if it passes the base rules and keeps most of its words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, documents, query, table

SYMBOLS = "#*$%&|<>"
# Terminal_Punctuation of Unicode without commas, the ellipsis, and the Armenian marks inside words. Thai and Lao write
# sentences without any mark: a letter of theirs counts as one.
SENTENCE_END = re.compile(
    "[.!?…;:\u037e\u0387\u055c\u055e\u0589\u05c3\u061b\u061d-\u061f\u06d4\u0700-\u070a\u070c\u07f9\u0830-\u0835"
    "\u0837-\u083e\u085e\u0964\u0965\u0e01-\u0eff\u0f08\u0f0d-\u0f12\u104a\u104b\u1361\u1362\u1364-\u1368\u166e"
    "\u16eb-\u16ed\u1735\u1736\u17d4-\u17d6\u17da\u1803-\u1805\u1809\u1944\u1945\u1aa8-\u1aab\u1b4e\u1b4f\u1b5a\u1b5b"
    "\u1b5d-\u1b5f\u1b7d-\u1b7f\u1c3b-\u1c3f\u1c7e\u1c7f\u2024\u203c\u203d\u2047-\u2049\u2cf9-\u2cfb\u2e2e\u2e3c\u2e53"
    "\u2e54\u3002\ua4ff\ua60e\ua60f\ua6f3\ua6f4\ua6f6\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f\ua9c7-\ua9c9\uaa5d-\uaa5f"
    "\uaadf\uaaf0\uaaf1\uabeb\ufe12-\ufe16\ufe52\ufe54-\ufe57\uff01\uff0e\uff1a\uff1b\uff1f\uff61"
    "\U00011047-\U0001104d\U000110be-\U000110c1\U00011141-\U00011143\U0001e95e\U0001e95f]")
SEPARATORS = re.compile("[|»›•→]| [>/] |::")
# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "copyright", "©", "cookie", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "javascript", "licensed under", "this work is licensed", "public license",
    "subscribe to", "sign up", "log in", "sign in", "click here", "read more", "share this", "follow us",
    "powered by", "lorem ipsum", "skip to content", "back to top", "advertisement", "we use cookies",
    "this site uses cookies", "this website uses cookies", "you agree to our use of cookies", "please enable javascript",
    "javascript is disabled",
)
LETTER = "[0-9a-z\u00df-\u024f]"  # none of them may stand beside a phrase; a plural s may
PHRASES = re.compile("©|" + rf"(?<!{LETTER})(?:" + "|".join(
    re.escape(p) for p in sorted(BOILERPLATE, key=len, reverse=True) if p != "©") + rf")s?(?!{LETTER})")

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
            "lost_lines long, lost_words long, clean_text string")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # Windows with unlike hashes differ; only if two hashes agree are the windows numbered, word by word, to compare them.
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes = (hashes ^ codes[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():
        return 0
    first = codes[:n]
    for k in range(1, width):
        _, first, count = np.unique(first * len(number) + codes[k:k + n], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[first] > 1)
    if not len(twice):
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def line_fails(line: str, words: list[bytes]) -> bool:
    """The rules for one line with at least one word that is no repeat of an earlier line."""
    n, signs = len(words), sum(map(line.count, SYMBOLS))
    if signs > n / 2 + 1 or 10 * signs > len(line):
        return True
    if len(SEPARATORS.findall(line)) * 3 >= n > 1:
        return True
    if n >= 12 and not SENTENCE_END.search(line):
        return True
    if n <= 40 and (phrases := PHRASES.findall(line.lower())):
        if 4 * sum(len(p.split()) for p in phrases) >= n or n < 12 and not SENTENCE_END.search(line):
            return True
    if n >= 4 and line.isupper():
        return True
    if n >= 8 and 3 * sum(a == b for a, b in zip(words, words[1:])) > n:
        return True
    return line.count("!") * 4 > n + 8


def measure(text: str | None) -> tuple:
    """The base counts of the contract and what the line rules take out."""
    text = text or ""
    blank = sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    words: list[bytes] = []
    kept, lines, twice, lost, lost_words = [], 0, 0, 0, 0
    for line in text.split("\n"):
        if not (own := line.encode("utf-8", "surrogatepass").split()):
            kept.append(line)
            continue
        lines += 1
        words += own
        again = line in seen
        twice += again
        seen.add(line)
        if again or line_fails(line, own):
            lost += 1
            lost_words += len(own)
        else:
            kept.append(line)
    return (len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), twice, repeated_words(words), lines, lost,
            lost_words, "\n".join(kept))


def judged(rows: DataFrame) -> DataFrame:
    """Measures behind all columns of ``rows``; its column ``text`` is measured."""
    place = rows.columns.index("text")
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column(place)]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*found))[:-1]] or [pa.array([], pa.int64())] * 8
            columns += [pa.array([f[-1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), MEASURES])
    return bounded_batches(rows).mapInArrow(run, schema)


def verdict(measured: DataFrame, max_lost: float) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.4) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the text without failing lines (``clean_text``), one row per document.

    ``max_lost``: the share of its words that a document may lose. Words are runs without the six ASCII white-space
    characters; a null or empty text has none and fails the base rules, as does any text below 10 words. A text is
    judged whole, whatever its length. Repeated rows are judged alike; an empty table gives no rows; further columns
    are ignored.
    """
    rows = documents(docs, id_col, text_col)
    made = verdict(judged(rows.select("text", "doc_id")), max_lost)
    return made.select("doc_id", *[c for c in made.columns if c not in ("doc_id", "text")])


def clean_documents(docs: DataFrame, max_lost: float = 0.4) -> DataFrame:
    """The columns of ``documents`` of those that are kept, without their failing lines."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source", "n_chars")
    return verdict(judged(own), max_lost).where("kept").select(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source", "n_chars")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    """Checked against a brute-force count and planted lines in ``tests/llm/test_quality.py``."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")
