import re
from collections import Counter

from citespark.llm.quality import clean_documents, line_fails, quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    hit = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def rows(df):
    return [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
             r["base_failed"]) for r in quality_rules(df).collect()]


def test_counts_are_brute_force(small, odd, nothing, spark):
    strange = spark.createDataFrame(
        [(1, "a\xa0b c\x85d\x1ce   f"), (2, "x x x x x x x"), (3, "l\nl\nl\n \n"), (4, "a b c d e f a b c d e g")],
        "doc_id long, text string")
    for df in (small, odd, strange):
        assert sorted(map(str, rows(df))) == sorted(str((r["doc_id"], *brute(r["text"]))) for r in df.collect())
    assert rows(nothing) == []


def test_lines_decide(spark):
    good = "This is a sentence with enough words in it, and it ends well. So does this other one."
    texts = {1: good, 2: good + "\nHome | News | About | Shop\nAll rights reserved.", 3: "Home | A | B | C | D\n" * 1 + "And | so | on | it | goes",
             4: "SHOUT!! ALL!! THE!! TIME!! IN!! THIS!! PLACE!! AND!! MORE!! NOW!!", 5: "one### two*** three$$$ four&&& five### six*** seven%%% eight### nine$$$ ten###"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in quality_rules(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert got[2][1] == good


def test_labels_agree(small, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = quality_rules(small).join(labels, "doc_id").where("NOT base_failed").collect()
    clean = [r["kept"] for r in found if r["quality"] == 1]
    junk = [r["kept"] for r in found if r["quality"] == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_stage_keeps_columns(small, odd):
    assert clean_documents(small).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in clean_documents(odd).collect()} == {1, 2, 7, 8, None}


def test_sentences_of_all_scripts_and_prose_with_phrases_stay():
    """Sentence marks beyond Latin ones; a phrase fails a line only if it is a large part of it."""
    for mark in "।۔።։။។！？；：":
        assert not line_fails(" ".join(["शब्द", "और"] * 7) + mark, [b"x", b"y"] * 7)
    assert not line_fails(" ".join(["ภาษาไทย", "คำ"] * 7), [b"x", b"y"] * 7)
    assert line_fails(" ".join(["one", "two"] * 7), [b"x", b"y"] * 7)
    stay = ["The catalog in the hall lists every book that the town has owned.", "She wrote of it on her blog in May.",
            "His design in glass won the prize, and a dialog in the second act was cut.",
            "In the kitchen my aunt gave each child one cookie and a glass of cold milk before the long walk home.",
            "The court found that copyright in the letters had passed to the heirs when the author died in 1931.",
            "He learned JavaScript at night and wrote his first small game for the school fair in the next spring."]
    go = ["All rights reserved.", "© 2024 Acme Corporation and its affiliates worldwide", "Licensed under the Apache License, Version 2.0.",
          "This work is licensed under the GNU General Public License, version 3.", "Log in", "Advertisements",
          "This website uses cookies to ensure you get the best experience on our website.", "Sign up today for the letter"]
    assert [t for t in stay if line_fails(t, t.encode().split())] == []
    assert [t for t in go if not line_fails(t, t.encode().split())] == []
