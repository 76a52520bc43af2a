import re

import pytest

from citespark.llm.pii import pseudonyms


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def changed(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["pii_kinds"]) for r in pseudonyms(df, key).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_link(spark):
    texts = ["a 4111 1111 1111 1111 b", "4111111111111111", "4111-1111-1111-1112", "mail Jo.Doe7@x.example.com.",
             "DE89 3704 0044 0532 0130 00", "ip 1.43.173.185, 999.1.1.1", "1999-02-28 and 28.02.1999, 31.02.2000",
             "123-45-6789 666-12-1234", "+1 (183) 555-1276 or +1 183 555 1276", "plain 12 text 3.5", "02/28/1999"]
    got = changed(spark, texts)
    assert [k for _, k in got] == [["card"], ["card"], [], ["email"], ["iban"], ["ipv4"], ["date", "date"], ["ssn"],
                                   ["phone", "phone"], [], ["date"]]
    for (new, kinds), old in zip(got, texts):
        assert re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub(
            r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))) or "ipv4" in kinds
        assert (new != old) == bool(kinds)
    assert re.sub(r"\D", "", got[0][0]) == got[1][0] and luhn(got[1][0])
    iban = got[4][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    day = got[6][0][:10]
    assert f"{day[8:]}.{day[5:7]}.{day[:4]}" in got[6][0] and got[10][0] == f"{day[5:7]}/{day[8:]}/{day[:4]}"
    assert "31.02.2000" in got[6][0] and "666-12-1234" in got[7][0] and "999.1.1.1" in got[5][0]
    one, two = got[8][0].split(" or ")
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and one.startswith("+1 (")
    assert changed(spark, texts) == got and changed(spark, texts, "other") != got


def test_neighbours_do_not_hide_values(spark):
    """(before, value, behind): the value is replaced as it is alone, what stands beside it stays."""
    card, es, be, us = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "+1 415 555 2671"
    cases = [("", card, " 12/25"), ("", card, " 123"), ("", card, " 2 items"), ("no 12 ", card, ""), ("", es, " BIC X"),
             ("", "ES9121000418450200051332", " EUR"), ("", be, " BANK"), ("DE12 CDEF GHIJ ", card, " 7"), ("", us, " 2024 10"),
             ("", us, " 2024"), ("", "2024-05-01", "T10:00"), ("", "2024-05-01", "T10:00:00Z"), ("x ", "+49 30 1234567", " 2024"),
             ("", be, " 12 " + "9" * 3), ("", "3782 822463 10005", " 99")]
    alone = changed(spark, [value for _, value, _ in cases])
    beside = changed(spark, ["".join(case) for case in cases])
    for (before, value, behind), (new, kinds), (text, found) in zip(cases, alone, beside):
        assert len(kinds) == 1 and new != value
        assert (text, found) == (before + new + behind, kinds)
    both = changed(spark, [f"{card} {card}", f"{us} {es} {card}"])
    assert both[0] == (f"{alone[0][0]} {alone[0][0]}", ["card", "card"])
    assert both[1] == (f"{alone[8][0]} {alone[4][0]} {alone[0][0]}", ["phone", "iban", "card"])
    mixed = changed(spark, [f"{us} 2024-05-01 1.2.3.4 12a@x.de {card}.", "2024-05-01 a 1.2.3.4 b 12a@x.de", "1 2 3 4 " * 500])
    assert mixed[0][1] == ["phone", "date", "ipv4", "email", "card"] and mixed[0][0].endswith(f" {alone[0][0]}.")
    assert mixed[0][0].split()[4:7] == [w for w in mixed[1][0].split() if len(w) > 1]


def test_clashing_names(spark):
    df = spark.sql("SELECT 'a@b.de' AS text, 1 AS _pii_result, 2 AS PII_KINDS, 3 AS `_PII_result_`")
    out = pseudonyms(df, "k")
    assert out.columns == ["text", "_pii_result", "_PII_result_", "pii_kinds"]
    assert out.collect()[0][1:] == (1, 3, ["email"])


def test_permutations_are_one_to_one(spark):
    """All days of some years, all small areas of numbers: no two values share a pseudonym."""
    days = spark.sql("SELECT explode(sequence(date'1998-01-01', date'2001-12-31')) AS d").selectExpr(
        "cast(d AS string) AS text")
    assert pseudonyms(days, "k").select("text").distinct().count() == days.count()
    numbers = spark.range(1, 2000).selectExpr("concat('123-45-', lpad(id, 4, '0')) AS text")
    out = pseudonyms(numbers, "k")
    assert out.select("text").distinct().count() == 1999
    assert out.where(r"text RLIKE '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'").count() == 1999
    hosts = spark.range(3000).selectExpr("concat('10.0.', id div 256, '.', id % 256) AS text")
    assert pseudonyms(hosts, "k").select("text").distinct().count() == 3000
    phones = spark.range(3000).selectExpr("concat('+1 200 555 ', lpad(id, 4, '0')) AS text")
    assert pseudonyms(phones, "k").select("text").distinct().count() == 3000


def test_documents_lose_their_values(small):
    out = {r["doc_id"]: r["text"] for r in pseudonyms(small, "k").collect()}
    for r in small.collect():
        old, new = r["text"], out[r["doc_id"]]
        for m in re.findall(r"[\w.]+@[\w.]+\w|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|\+1 \(\d+\) \d+-\d+", old):
            assert m not in new
        for m in re.findall(r"(?<![\w.-])\d{16}(?![\w-])", old):
            assert (m in new) != luhn(m)


def test_odd_rows(odd, nothing):
    out = pseudonyms(odd, "k")
    assert out.columns == [c for c in odd.columns if c != "pii_kinds"] + ["pii_kinds"]
    before = sorted(str(r["text"]) for r in odd.collect())
    assert sorted(str(r["text"]) for r in out.collect()) == before
    assert pseudonyms(nothing, "k").count() == 0
    with pytest.raises(ValueError):
        pseudonyms(odd, "")
