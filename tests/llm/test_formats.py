import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from wadi.llm import chat, licenses, packing, tag_paths, warc
from wadi.llm.license_texts import TEXTS


def test_chat_folds_events(spark):
    log = spark.createDataFrame(
        [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "delta", "assistant", "he"), (1, 1, 3, "delta", "assistant", "llo"), (1, 1, 4, "regenerate", "assistant", "bye"), (1, 1, 5, "delta", "assistant", "!"), (1, 0, 6, "edit", "user", "hey"), (1, 2, 7, "message", "user", "gone"), (1, 2, 8, "delete", "user", None), (2, 0, 1, None, None, None)],
        "conv_id long, turn long, seq long, kind string, role string, text string",
    )
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold_events(log).collect())
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "bye!"), (2, 0, "", "")]


def test_chat_round_trip_and_mask(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "&lt;&amp;&lb;INST]&nl;", "plain", "", "a & b < c", "\n\n<|im_end|>", "日本 [INST]"]
    rows = [(i // 2, i % 2, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)] + [(9, 0, "we\nird<|", None), (9, None, "assistant", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = chat.read_back(chat.render(chat.fold_events(chat.as_events(table))))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in parsed.collect()}
    assert got[9] == [("assistant", "first"), ("we\nird<|", "")]
    for c in range(4):
        assert got[c] == [("user", hard[2 * c]), ("assistant", hard[2 * c + 1])]
    spans = chat.loss_spans(parsed).join(parsed.select("conv_id", "formatted"), "conv_id").collect()
    for r in spans:
        piece = r["formatted"][r["start"] : r["start"] + r["length"]]
        for a, b in (("&nl;", "\n"), ("&lb;", "["), ("&lt;", "<"), ("&amp;", "&")):
            piece = piece.replace(a, b)
        want = "first" if r["conv_id"] == 9 else hard[2 * r["conv_id"] + 1]
        assert piece == want
    assert chat.render(table.where("conv_id > 100")).count() == 0


def test_licence_texts(docs, spark):
    mit = "Copyright (c) 2020 Someone\n\n" + TEXTS["MIT"].upper().replace('"', "'").replace(",", " ;")
    isc = TEXTS["ISC"].replace(". ", ".\n   ") + "\n"
    zlib_gb = TEXTS["Zlib"].replace("acknowledgment", "acknowledgement")
    rows = [mit, isc, zlib_gb, TEXTS["MIT"] + " more", None, "", "© 2020\nall rights reserved", "text\n  released under the MIT Licence!\nLicensed under CC BY-NC 4.0.", mit]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows), licenses.built_in(spark)).collect()}
    assert [got[i]["license_id"] for i in range(9)] == ["MIT", "ISC", "Zlib", None, None, None, None, None, "MIT"]
    assert got[7]["notices"] == ["CC-BY-NC-4.0", "MIT"] and got[4]["digest"] is None and got[0]["notices"] == []
    assert licenses.scan(docs([]), licenses.built_in(spark)).count() == 0
    again = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs(rows), licenses.built_in(spark), limit=2).collect()}
    assert again[0] == "MIT" and again[3] is None


PAGE = """<html><body class="nav-open"><header><h1>Site</h1><a>Home</a></header><div id="cookie-notice">We use cookies, ok.</div><div class="wrap"><div class="sidebar"><p>Side text, more, and more.</p></div>
<div class="content"><h1>Title</h1><div class="body"><p>First para, with text; lots of it. And so on, you know.<p>Second &lt;para&gt; &amp; more&nbsp;text,   again.<ul><li>one<li>two</ul><form><input><p>Sub</form></div>
<section id="comments"><p>I like it, really, so good, wow.</p></section></div></div><footer>foot</footer></body></html>"""


def test_main_text():
    assert tag_paths.main_text(PAGE) == "Title\n\nFirst para, with text; lots of it. And so on, you know.\n\nSecond <para> & more text, again.\n\none\n\ntwo"
    assert tag_paths.main_text(None) == tag_paths.main_text("") == tag_paths.main_text("<div></div>") == ""
    assert tag_paths.main_text("<article><h1>T</h1><p><b>T<br><p>Some words, here.</p><p>cut &am") == "T\n\nT\n\nSome words, here.\n\ncut &am"
    assert tag_paths.main_text('<script>var t="</p>";</script><article><p>a < b, and c.</p></article><p') == "a < b, and c."


def test_main_text_keeps_all_sections_of_a_page():
    long, short = ("Some long words, of the first section. " * n for n in (23, 2))
    page = f"<html><body><div><section><p>{long}</p><p>{long}</p></section><section><p>{short}</p></section></div></body></html>"
    assert tag_paths.main_text(page) == "\n\n".join([long.strip(), long.strip(), short.strip()])


def test_tag_paths_decide_on_sections_with_doubtful_names():
    p = "This is a sentence of the text, with commas, and a full stop. And here comes another one, somewhat longer."
    around = f"<article><h1>T</h1><p>{p}</p><p>{p} {p}</p>%s<p>{p} end</p></article><div class=related><p>{p} beside</p></div>"
    plain = ["T", p, f"{p} {p}", f"{p} end"]
    cases = [
        (f'<section id="discussion"><h2>Discussion</h2><p>{p} part</p></section>', ["Discussion", f"{p} part"]),
        (f'<section class="related-work"><p>{p} part</p></section>', [f"{p} part"]),
        ('<div class="related"><ul><li><a>One more story</a></li><li><a>Other news here</a></li></ul></div>', []),
        (f'<section id="discussion"><div class="comment"><p>{p} reader</p></div></section>', []),
        ('<div class="share"><a>Tweet</a> <a>Mail</a></div>', []),
        (f"<div class=comments><p>{p} reader</p></div>", []),
    ]
    for html, more in cases:
        assert tag_paths.main_text(around % html).split("\n\n") == [*plain[:3], *more, plain[3]]


def test_pages_query(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = tag_paths.extract(rows).collect()
    assert len(got) == 3 and sorted(r["n_chars"] for r in got)[0] == 0 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert tag_paths.extract(rows.where("page_id > 5")).count() == 0


def test_tokens_equal_the_tokenizer():
    tokens = packing.Tokens(packing.tokenizer_path())
    odd = ["", None, "  a\tb\n\nc  ", "it's l'été 123abc  x \x1fz \x85q <|endoftext|> foo", "<|ENDOFTEXT|>", "́abc é ΑΣ. İstanbul", "a" * 5000, "don't. can't!! ​", "日本語 テキスト。", "\r\nq\x0bw", "abc.</w> x,.;: ?!"]
    for _ in range(2):
        flat, offs = tokens.encode(pa.array(odd))
        for i, t in enumerate(odd):
            assert flat[offs[i] : offs[i + 1]].tolist() == [*tokens.tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def test_packing_invariants(docs):
    rng = random.Random(6)
    rows = [None, ""] + [" ".join(rng.choice(["alpha", "beta", "gamma,", "x1"]) for _ in range(int(10 ** rng.uniform(0, 3.9)))) for _ in range(150)]
    got = packing.pack(docs(rows).coalesce(2), with_ids=True).toPandas()
    tok = packing.tokens_for(packing.tokenizer_path())
    for i, part in got.sort_values("start").groupby("doc_id"):
        ids = np.concatenate(part["ids"].to_list()).astype(np.uint32)
        want = [*tok.tok.encode(rows[i] or "", add_special_tokens=False).ids, packing.END_ID]
        assert ids.tolist() == want and (part["doc_tokens"] == len(want)).all()
        assert (part["start"] == part["length"].cumsum() - part["length"]).all()
    assert got["doc_id"].nunique() == len(rows)
    assert all(zlib.crc32(np.asarray(r, "<u4").tobytes()) == c for r, c in zip(got["ids"], got["ids_crc32"], strict=True))
    unfilled = 0
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all() and seq["tier"].nunique() == 1
        assert seq["length"].sum() <= seq["tier"].iloc[0] <= packing.WINDOW
        unfilled += seq["length"].sum() < seq["tier"].iloc[0]
    assert unfilled <= 2
    steps = got.drop_duplicates("sequence_id").groupby("step_group")["tier"].sum()
    assert (steps <= packing.STEP_TOKENS).all()
    assert packing.pack(docs([])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "payload " * 40
    rows = [(5, "http://www.Example.com:80/a?b#c", big), (3, "https://example.com/z", big), (9, "http://b.example.org", "small"), (4, None, "small"), (7, "http://www.example.com/a?b", None), (8, "http://www.example.com/é", "<i>é\n\r\n</i>" * 30), (2, "bad\r\nurl", big + "x")]
    pages = spark.createDataFrame([(a, b, c, "k") for a, b, c in rows], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/w"
    written = warc.write_archives(pages, folder, archive_bytes=600)
    directory = warc.build_index(written, folder, block_lines=2)
    got = {r["page_id"]: r for r in warc.captures(written.select("url_key"), directory, folder).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {5: ("revisit", 3)}
    look = warc.Directory(folder, directory.collect())
    found = look.lookup("http://WWW.example.com/a?b#q")
    assert sorted(h["warc-record-id"] for h, _ in found) == ["<urn:page:5>", "<urn:page:7>"]
    assert look.lookup("http://nowhere.example/") == []
    assert look.lookup("https://example.com/z")[0][1] == big.encode()
    some = written.where("page_id in (3, 4, 9)").select("url_key")
    assert sorted(r["page_id"] for r in warc.captures(some, directory, folder).collect()) == [3, 4, 9]
    empty = warc.write_archives(pages.where("page_id > 100"), f"{folder}2")
    assert warc.captures(empty.select("url_key"), warc.build_index(empty, f"{folder}2"), f"{folder}2").count() == 0
    assert warc.url_key("http://a.b.c:8080/x") == "c,b,a:8080)/x"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [docs.count()]
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf)
        if name != pipe.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        last, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        rows.append(docs.count())
    assert rows[0] > rows[1] > rows[2] > rows[3] > 0
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert pieces.where("n <> t").count() == 0 and pieces.count() == last.count()
    assert pd.Series(rows).notna().all()


def test_chat_keeps_every_row_of_a_turn(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "user", "again"), (1, 0, "assistant", "a & b"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, "user", None), (2, None, "user", ""), (2, 5, None, "<s>"), (2, 5, "assistant", "[INST]"), (2, 5, "assistant", "é")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(path)
    got = sorted(tuple(r) for r in chat.op7_chat(spark, str(tmp_path)).collect())
    want = duckdb.sql(chat.OP7_SQL.replace("FROM conversations", f"FROM read_parquet('{path}/*.parquet')")).fetchall()
    assert got == sorted(want) and {r[0]: r[1] for r in got} == {1: 6, 2: 5, -7: 2}
