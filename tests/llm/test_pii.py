import re

from trackweave.llm.pii import KINDS, Feistel, Pseudonyms, luhn, pseudonymise

TEXT = (
    "Mail jane.doe-7@example.org or call (415) 555-0132, +1 212-555-0199. Card 4111 1111 1111 1111 and 4111111111111111, "
    "IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789, host 192.168.10.7, on 2021-02-28 and 28.02.2021."
)
PLAIN = "Order 4111111111111112 ran 2021-02-30, version 1.2.3, host 999.1.1.1, SSN 000-12-3456, 12 apples @ home."


def test_feistel_is_a_permutation():
    for n in (2, 3, 10, 97, 1000):
        f = Feistel(b"k", "t", n)
        assert sorted(map(f.map, range(n))) == list(range(n))
        assert all(f.map(f.map(x), back=True) == x for x in range(n))
    assert [Feistel(b"k", "t", 1000).map(x) for x in range(50)] != [Feistel(b"other", "t", 1000).map(x) for x in range(50)]


def test_values_keep_their_format_and_come_back():
    new, found = Pseudonyms(b"k").replace(TEXT)
    kinds = [k for k, _, _ in found]
    assert [kinds.count(k) for k in KINDS] == [1, 2, 1, 1, 2, 1, 2]
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"\d", "0", re.sub(r"\d+(\.\d+){3}", "IP", t)))  # noqa: E731  an address's numbers have one to three digits
    assert shape(new) == shape(TEXT)
    value = {k: v for k, _, v in found}
    cards = [re.sub(" ", "", v) for k, _, v in found if k == "card"]
    assert cards[0] == cards[1] != "4111111111111111" and luhn(cards[0][:-1]) == int(cards[0][-1])
    dates = [v for k, _, v in found if k == "date"]
    assert dates[0].split("-") == dates[1].split(".")[::-1]  # one day, one pseudonym, in either notation
    assert value["email"].endswith("@example.org")
    iban = value["iban"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert Pseudonyms(b"k").replace(new, back=True)[0] == TEXT


def test_numbers_outside_the_ranges_in_use():
    made = Pseudonyms(b"k")
    for kind, values, used in (
        ("phone", ["+1 (017) 555-7713", "(199) 999-9999", "000-000-0000", "200-199-0001", "999.000.1234", "999-199-9999"], lambda v: min(re.sub(r"\D", "", v)[-10], re.sub(r"\D", "", v)[-7]) > "1"),
        ("ip", ["233.254.104.120", "248.40.198.62", "0.0.0.0", "0.255.255.255", "224.0.0.0", "255.255.255.255"], lambda v: 1 <= int(v.split(".")[0]) <= 223),
    ):
        for v in values:
            new, found = made.replace(v)
            assert [f[0] for f in found] == [kind] and new != v and not used(new) and made.replace(new, back=True)[0] == v
            if kind == "phone":
                assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", v)
    assert len({made.replace(f"({a:03d}) {e:03d}-0000")[0] for a in range(0, 1000, 7) for e in range(0, 1000, 7)}) == 143 * 143


def test_recall_on_the_whole_table(spark):
    """All that the documents hold by formats counted apart from the operator's patterns."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = dict.fromkeys(("phone", "ip", "email", "card"), 0)
    for (text,) in docs.select("text").where("text is not null").collect():
        want["phone"] += len(re.findall(r"\(\d{3}\) \d{3}-\d{4}", text))
        want["ip"] += sum(max(map(int, v.split("."))) < 256 for v in re.findall(r"\d+\.\d+\.\d+\.\d+", text))
        want["email"] += text.count("@")
        want["card"] += sum(luhn(v[:-1]) == int(v[-1]) for v in re.findall(r"(?<!\d)\d{16}(?!\d)", text))
    made = pseudonymise(docs, b"k")
    got = made.selectExpr(*(f"sum(n_{k}) {k}" for k in want)).first().asDict()
    assert got == want and min(want.values()) > 0
    assert pseudonymise(made, b"k", back=True).select("doc_id", "text").exceptAll(docs).isEmpty()


def test_what_fails_validation_stays():
    assert Pseudonyms(b"k").replace(PLAIN) == (PLAIN, [])


def test_rows(spark, docs, nothing):
    rows = [(1, TEXT, 5), (2, "x " * 100_000 + TEXT, 5), (3, None, 5), (4, "", 5), (1, TEXT, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_card long")
    made = pseudonymise(df, b"k")
    got = made.collect()
    assert [r["n_card"] for r in got] == [2, 2, 0, 0, 2]
    assert got[0] == got[4] and got[1]["text"].endswith(got[0]["text"]) and got[2]["text"] is None
    assert [r["text"] for r in pseudonymise(made, b"k", back=True).collect()] == [r[1] for r in rows]
    assert pseudonymise(nothing, b"k").collect() == []
    assert pseudonymise(docs, b"k").count() == docs.count()


def test_numbers_of_other_countries_keep_the_country():
    made = Pseudonyms(b"k")
    for text in ("call +44 20 7946 0958 now", "call +49 (30) 901820 12 now", "+33 1 23 45 67 89"):
        new, found = made.replace(text)
        assert [k for k, *_ in found] == ["phone"] and new != text and new[: text.index("+") + 3] == text[: text.index("+") + 3]
        assert [c.isdigit() for c in new] == [c.isdigit() for c in text] and made.replace(new, back=True)[0] == text
    assert made.replace("+44 12 34")[1] == []


def test_long_runs_take_linear_time():
    made = Pseudonyms(b"k")
    for text in ("a%" * 200_000, "a.b-" * 100_000 + "@", "+1 (" * 100_000, "1 " * 200_000):
        assert made.replace(text) == (text, [])


def test_days_of_timestamps():
    made = Pseudonyms(b"k")
    text = "at 2024-01-02T10:00:00Z, 2024-01-02T1000 and 2024-01-02; not 2024-01-02Text, 2024-01-02-3 or x2024-01-02T10:00"
    new, found = made.replace(text)
    assert [k for k, *_ in found] == ["date"] * 3 and len({v for *_, v in found}) == 1 and found[0][2] != "2024-01-02"
    assert "T10:00:00Z" in new and "2024-01-02Text" in new and made.replace(new, back=True)[0] == text
