import hashlib
import random
import re

from pyspark.sql import functions as F

from wadi.llm import fill_middle as M

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=M.SEED, rate=M.RATE, suffix_first=M.SUFFIX_FIRST):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n=400):
    rng = random.Random(8)
    alphabet = ["a", "B", "é", "日", "😀", " ", "  ", "\n", "\t", "\x0b", "\x00", ".", " ", "<", "S>", "<P", ">", " ", " "]
    return [None, "", " ", "\n\n", "one", " one", "one ", "<P>", "a <M> b", "x<"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_against_plain_units():
    for rate in (50, 100):
        for i, t in enumerate(texts()):
            assert M.transform(i, t, rate=rate) == brute(i, t, rate=rate)


def test_select_finds_every_bit():
    rng = random.Random(1)
    for _ in range(50):
        bits = rng.getrandbits(rng.randint(1, 300)) | 1
        places = [i for i in range(bits.bit_length()) if bits >> i & 1]
        assert [M.select(bits, k + 1) for k in range(len(places))] == places


def test_table_round_trip(docs):
    rows = texts(200)
    ids = [*range(len(rows) - 2), 3, None]
    made = M.fill_in_middle(docs(rows, ids), rate=100)
    got = made.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["output"]) for r in got) == sorted((i is None, i or 0, brute(i, t, rate=100)[4]) for i, t in zip(ids, rows, strict=True))
    assert sorted(r["back"] for r in got) == sorted(t or "" for t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_equal_rows_empty_table_and_long_text(docs):
    assert M.fill_in_middle(docs([])).count() == 0
    twice = M.fill_in_middle(docs(["a b c d"] * 2, [7, 7])).collect()
    assert twice[0] == twice[1]
    long = "Wörter und  mehr\n" * 200_000
    assert M.transform(5, long, rate=100) == brute(5, long, rate=100)


def test_rates_hold_over_ids():
    forms = [M.transform(i, "a b c")[1] for i in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.5) < 0.04 and abs(forms.count("psm") / 4000 - 0.1) < 0.03
