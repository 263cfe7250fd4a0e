"""The corpus operators against brute force, on hand-made rows with nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import html
import json
import base64
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotwise.llm import components as graph
from plotwise.llm import embedding_dedup, html_tree, language, media, minhash, mixing, packing, pii, quality, queries, secret_scan
from plotwise.llm.embedding_dedup import near_vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"
WORDS = [a + b for a in ("ta", "ri", "mo", "ne", "su", "ka", "lo", "vi") for b in ("l", "ren", "dos", "mi", "pta", "que", "s", "nor", "ge", "fa")]


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(200, 1)
    near = base.replace(base.split()[50], "changed", 1)
    texts = [base, base, near, prose(200, 2), None, "", "   ", "one", "one", prose(20_000, 3), "a b  c\n", None, "é€" * 300]
    rows = [(i if i != 11 else None, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "x", "k") for i, t in enumerate(texts)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, DOCS)


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(mixing.OP2_SQL).fetchall())
    assert sorted(tuple(r) for r in mixing.op2_mix_sources(spark, SF).collect()) == want


def test_mixing_edges(spark, docs):
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
    by = collections.defaultdict(int)
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 1 for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns


def test_minhash_against_brute_force(spark, docs):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got[0] == got[1] == got[2] == 0 and got[3] == 3 and got[7] == got[8] == 7
    assert got[4] == 4 and got[5] == 5 and got[6] == 6
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sets = {r.doc_id: {tuple(r.text.lower().split()[i : i + 5]) for i in range(max(1, len(r.text.split()) - 4))} for r in rows}
    got = {r.doc_id: r.class_id for r in minhash.op3_near_duplicates(spark, SF).collect()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                assert got[a] == got[b]


def test_dedup_stage_keeps_one(spark, docs):
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [0, 3, 4, 5, 6, 7, 9, 10, 12]


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS_PER_TASK", 8)
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (33, 33)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30, 32: 30}


def test_drifting_group_against_brute_force(spark, monkeypatch):
    """Texts whose links form chains: no link may be lost because a bucket's least text is not one of its ends."""
    draw, base = random.Random(5), prose(120, 9).split()
    texts = []
    for _ in range(40):
        words = list(base)
        for at in draw.sample(range(120), draw.randint(1, 5)):
            words[at] = draw.choice(WORDS)
        texts.append(" ".join(words))
    monkeypatch.setattr(minhash, "slots", lambda work, n: [0, minhash.SLOTS // 2, minhash.SLOTS])
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(made).collect()}
    idf = minhash.inverse_frequencies(made)
    sets = [minhash.shingles(minhash.word_hashes(t), idf) for t in texts]
    want = list(range(40))
    for i in range(40):
        for j in range(i):
            if minhash.alike(sets[i], sets[j]) >= 0.8 and want[i] != want[j]:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert len(set(want)) > 1
    assert got == dict(enumerate(want))


def test_sampler_estimates_weighted_jaccard():
    draw = np.random.default_rng(3)
    h = draw.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64)
    sampler = minhash.Sampler()
    w = np.ones(300)
    one, two = sampler.bands(h[:300], w, np.array([0])), sampler.bands(h[:300][::-1].copy(), w, np.array([0]))
    assert (one == two).all()
    assert (sampler.bands(h[100:], w, np.array([0])) == one).mean() < 0.3


def test_bitmaps_never_rule_out_a_link(spark):
    """Pairs from far below to above 0.8, with repeated lines: what is linked is always within reach, what is far off is not."""
    draw, texts = random.Random(11), []
    for size in (30, 150, 400):
        base = prose(size, size).split()
        for edits in (1, 2, 3, 4, 6, 8, 12, 20):
            words = list(base) + base[:7] * draw.randint(0, 4)
            for at in draw.sample(range(len(words)), edits):
                words[at] = draw.choice(WORDS)
            texts.append(" ".join(words))
    idf = 1 + 3 * np.random.default_rng(4).random(minhash.IDF_SLOTS)
    sets = [minhash.shingles(minhash.word_hashes(t), idf) for t in texts]
    starts = np.cumsum([0] + [len(h) for h, _ in sets[:-1]])
    signs = minhash.Sampler().bands(np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets]), starts)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signs)], "i int, p array<bigint>")
    pairs = rows.join(rows.selectExpr("i as j", "p as q"), F.expr("i < j")).select("i", "j", minhash.within_reach("p", "q", 0.8).alias("near"))
    near = {(r.i, r.j): r.near for r in pairs.collect()}
    links = {k for k in near if minhash.alike(sets[k[0]], sets[k[1]]) >= 0.8}
    assert links and all(near[k] for k in links)
    assert not any(near[k] for k in near if minhash.alike(sets[k[0]], sets[k[1]]) < 0.3)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack(docs, context=64).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for doc, group in texts.items():
        if len(group) == 1:
            ids = np.array([*tk.encode(group[0], add_special_tokens=False).ids, 1], "<u4")
            pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
            assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
            assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
    total = sum(r.length for r in rows)
    cells = {(r.sequence_id, r.offset + i) for r in rows for i in range(r.length)}
    assert len(cells) == total and {s * 64 + o for s, o in cells} == set(range(total))
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a  b", " x\n\n y ", "l'un d'eux", "<|endoftext|> a", "\t a 　 b", "12 3.4 ²", "x " * 50])
def test_encoder_equals_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    assert np.frombuffer(packing.encoder(path)(text), "<u2").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_quality(spark):
    got = {r.doc_id: r for r in quality.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in labels if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert {r.s for r in docs.select(quality.score_column(model, F.col("text")).alias("s")).collect()} == {0.5}
    assert quality.keep_good(docs, none).columns == docs.columns


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 16))
    x[50:100] = x[:50] + 0.02 * draw.normal(size=(50, 16))
    x[100] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [None] * 16), (905, [1.0, 2.0]), (399, x[399].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in near_vectors(df).collect())
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(400, dtype=bool)
    found = {r[0]: r for r in got if r[0] < 399}
    assert sum(found[i][1] for i in range(399)) >= 0.9 * links[:399].sum()
    assert found[0][1] == 2 and found[100][2] == 0 and all(r[1] == 0 for r in got if r[0] >= 900)
    assert near_vectors(df.limit(0)).count() == 0


def third_in_one_group(n, d, seed):
    """Unit vectors of which a third are near copies of one (cosines around 0.99), with some pairs among the rest."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d))
    x[: n // 3] = x[0] / np.linalg.norm(x[0]) + 0.1 * draw.normal(size=(n // 3, d)) / d**0.5
    x[-200:-100] = x[-100:] + 0.1 * draw.normal(size=(100, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_forest_keeps_a_dense_group_together():
    """As deep as 200,000 vectors ask for, with a third of the rows in one group: the share of linked pairs that meet in a leaf."""
    x = third_in_one_group(20_000, 64, 3)
    near = [set() for _ in x]
    for k, tree in enumerate(embedding_dedup.forest(x, 200_000)):
        for leaf, rows in embedding_dedup.route(tree, x, np.arange(len(x))):
            for r in rows:
                near[r].add((k, leaf))
    pairs = np.random.default_rng(4).integers(0, len(x) // 3, (20_000, 2))
    linked = [(i, j) for i, j in pairs if i != j and x[i] @ x[j] >= 0.95]
    assert np.mean([bool(near[i] & near[j]) for i, j in linked]) >= 0.98


def test_vectors_of_a_dense_group_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    x = third_in_one_group(3000, 32, 6)
    want = (x @ x.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_vectors(df.repartition(3)).collect()}
    found = np.array([got[i].n_links for i in range(3000)])
    assert (found <= want).all() and found[:1000].sum() >= 0.98 * want[:1000].sum() and found[1000:].sum() >= 0.9 * want[1000:].sum() > 0
    assert {got[i].component_id for i in range(1000) if want[i]} == {0}


def test_large_leaves_are_split_again(spark, monkeypatch):
    """A forest far too shallow for its rows: leaves are split until small, but for a dense group; links are still counted once, and found."""
    for name, value in (("SAMPLE", 400), ("LEAF", 64), ("BLOCK", 150), ("LEAF_SAMPLE", 100)):
        monkeypatch.setattr(embedding_dedup, name, value)
    seen = []
    split_again = embedding_dedup.split_again

    def watched(placed, cosine):
        out = split_again(placed, cosine)
        seen.append((placed.groupBy("leaf").count().agg(F.max("count")).first()[0], sorted(r["count"] for r in out[0].groupBy("leaf").count().collect())))
        return out

    monkeypatch.setattr(embedding_dedup, "split_again", watched)
    draw = np.random.default_rng(8)
    x = draw.normal(size=(4000, 32))
    x[2000:] = x[:2000] + 0.15 * draw.normal(size=(2000, 32))
    x[:300] = x[0] + 0.1 * draw.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_vectors(df.repartition(3)).collect()}
    found = np.array([got[i].n_links for i in range(4000)])
    before, after = seen[0]
    assert before > 400 and np.mean([n <= 150 for n in after]) > 0.9
    assert (found <= want).all() and found[:300].sum() >= 0.95 * want[:300].sum() and found[300:].sum() >= 0.9 * want[300:].sum() > 1000


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.op7_language(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_language_edges(spark, docs):
    p = docs.select(language.predict_column({"en": b"one two"}, F.col("text")).alias("p"), "text").collect()
    assert all((r.p.lang_pred == "und") == (not language.normalised(r.text)) for r in p)
    assert language.learn(docs.limit(0)) == {}


def test_language_repeated_rows_teach_once(spark):
    rows = [(i, "en", f"the words of document {i} are few") for i in range(40)] + [(1, "en", "a hot row")] * 100 + [(i, "fr", f"les mots du document {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.learn(docs)
    assert list(got) == ["en", "fr"] and got["en"].count(b"a hot row") <= 1
    assert got == language.learn(docs.union(docs))


def test_secrets_base_and_structure():
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"})) + ".c2ln"
    body = bytes([2, 1, 0, 2, 33]) + bytes(33)
    der = bytes([0x30, len(body)]) + body
    cases = {
        "token=secret:abcdefghijklmnop": [],
        "PASSWORD = 'abcdefghijkl'": ["assign"],
        "AKIA" + "A" * 14: ["access"],
        "AKIA" + "A" * 13: [],
        "0123456789abcdef": ["hex"],
        "ſecret=abcdefghijklmn": [],
        f"x {token} y": ["jwt"],
        f"k {base64.b64encode(der).decode()} z": ["der"],
        f"k {der.hex()} z": ["hex", "der"],
        "eyJub3QganNvbg.e30.x": [],
    }
    for text, kinds in cases.items():
        assert [k for _, _, k in secret_scan.spans(text)] == kinds, text
    assert secret_scan.spans(None) == []


@pytest.mark.parametrize("gap", ["", " ", "\n", "\r\n", "\t", "  \n"])
def test_secrets_tokens_with_any_white_space(gap):
    parts = ["{" + gap + '"alg": "HS256"}', '{"sub": "1"}']
    token = ".".join(base64.urlsafe_b64encode(x.encode()).decode().rstrip("=") for x in parts) + ".c2ln"
    assert [(a, b) for a, b, k in secret_scan.spans(f"x {token} y") if k == "jwt"] == [(2, 2 + len(token))]
    token = base64.urlsafe_b64encode((gap + parts[0]).encode()).decode().rstrip("=") + token[token.index("."):]
    assert "jwt" in [k for _, _, k in secret_scan.spans(token)]


def test_secrets_rows(spark, docs):
    rows = docs.select("doc_id", secret_scan.scan_column(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    assert len(rows) == docs.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}


def plain_feistel(value, a, b, kind, key=pii.KEY):
    left, right = divmod(value, b)
    f = lambda i, x: int(hashlib.sha256(f"{key}:{kind}:{i}:{x}".encode()).hexdigest()[:12], 16)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + f(i, right)) % a
        else:
            right = (right + f(i, left)) % b
    return left * b + right


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    card = "4111111111111111"
    texts = [f"pay {card}!", f"again {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}.", "bad 4111111111111112", "ip 10.2.3.4, 999.1.1.1", "on 2024-02-29 not 2024-02-30", "call +1 (509) 555-6973%%%", "Anna.07@mail4.example.com", "ssn 123-45-6789", None, "", "plain text 12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.p for r in df.select("i", pii.pseudonymised(F.col("text")).alias("p")).collect()}
    new = got[0][4:20]
    body = f"{plain_feistel(int(card[:15]), 10**7, 10**8, 'card'):015d}"
    assert new[:15] == body and luhn(new) and new != card
    assert got[1] == f"again {new[:4]} {new[4:8]} {new[8:12]} {new[12:]}."
    assert got[2] == texts[2] and got[3].endswith(", 999.1.1.1") and "10.2.3.4" not in got[3]
    assert got[4].endswith("not 2024-02-30") and "2024-02-29" not in got[4]
    phone = f"{plain_feistel(5095556973, 10**5, 10**5, 'phone'):010d}"
    assert got[5] == f"call +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}%%%"
    assert got[6].endswith("@mail4.example.com") and got[6] != texts[6] and len(got[6]) == len(texts[6]) and got[6][4] == "."
    assert got[8] is None and got[9] == "" and got[10] == texts[10]


def test_hint_covers_every_pattern(spark):
    phones = [f"+{c}{a}{l}509{r}{b}555{d}6973" for c in ("1", "91", "919") for a in ("", " ", ".", "-") for l, r in (("", ""), ("(", ")")) for b in ("", " ", ".", "-") for d in ("", " ", ".", "-")]
    phones += ["+14155550123", "(509) 555-6973", "(509) 555.6973", "509-555-6973", "509.555.6973"]
    cards = ["4" * n for n in range(13, 20)] + [x.join(("4111", "1111", "1111", "1111")) for x in " -"] + [x.join(("3782", "822463", "10005")) for x in " -"]
    finds = [*phones, *cards, "a@b.c", "123-45-6789", "1999-01-31", "2024-02-29", "1.2.3.4", "255.255.255.255"]
    texts = [f"{x}{f}{y}" for f in finds for x, y in (("", ""), ("call ", ", thanks"), ("call ", "\nnow"))]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert df.where(F.col("text").rlike(pii.ANY)).count() == len(texts)
    assert [r.text for r in df.where(~F.col("text").rlike(pii.HINT)).collect()] == []
    got = spark.createDataFrame([("call +14155550123, thanks",), ("+14155550123 or a@b.example",)], "text string").select(pii.pseudonymised(F.col("text")).alias("p")).collect()
    assert got[0].p[5:17] == got[1].p[:12] != "+14155550123"


def test_feistel_is_a_permutation(spark):
    out = spark.range(110).select(pii.feistel(F.col("id"), F.lit(10).cast("long"), F.lit(11).cast("long"), "k", "t").alias("v"))
    assert sorted(r.v for r in out.collect()) == list(range(110))


def test_hide_private_keeps_columns(spark, docs):
    assert pii.hide_private(docs).columns == docs.columns


def test_html_blocks():
    page = "<html><head><title>t</title></head><body><header>H</header><nav><a>m</a></nav><div class='ad-box'>buy</div><article><header><h1>A &amp; B</h1></header><p>x <b>y</b>z&nbsp; w<br>v<p>q<script>var a='</p>';</script><section class='comments'>c</section><form>f</form></article><aside>s</aside><footer>f</footer>"
    assert html_tree.main_text(page) == "A & B\nx yz w v\nq"
    assert html_tree.main_text(None) == html_tree.main_text("") == html_tree.main_text("<!-- x") == ""
    assert html_tree.main_text("plain &lt;text") == "plain <text"


def test_html_style_tree_removes_repeated_branch(spark):
    pages = [(i, "http://h.example/" + str(i), f"<body><div class=x>Repeated strip on every page</div><div class=y><p>{prose(30, i)}</p></div></body>") for i in range(12)]
    df = spark.createDataFrame([*pages, (12, None, None), (13, "odd", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_tree.extract(df).collect()}
    assert got == {i: prose(30, i) for i in range(12)} | {12: "", 13: ""}
    assert html_tree.extract(df.limit(0)).count() == 0


def test_html_style_tree_decides_inside_and_outside_main(spark):
    """Body text beside a small article card stays; a strip that every page repeats inside main goes; few pages lose nothing."""
    page = lambda i: f"<body><main><div class=x>Repeated strip on every page</div><article><p>card {prose(3, 100 + i)}</p></article></main><div class=y><p>{prose(30, i)}</p></div></body>"
    df = spark.createDataFrame([(i, f"http://{'h' if i else 'alone'}.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_tree.extract(df).collect()}
    assert got.pop(0) == f"Repeated strip on every page\ncard {prose(3, 100)}\n{prose(30, 0)}"
    assert got == {i: f"card {prose(3, 100 + i)}\n{prose(30, i)}" for i in range(1, 12)}


def test_html_raw_text_ends_at_its_own_end_tag():
    script = "for(i=0;i<n;i++){go('</style>')}"
    assert html_tree.main_text(f"<script>{script}</script><p>article</p>") == "article"
    assert html_tree.main_text(f"<style>a<b{{}}</style><title>x <y</TITLE ><textarea>1<a '</textarea><p>one</p><SCRIPT>{script}</script-x> '</SCRIPT\n><p>two") == "one\ntwo"
    assert html_tree.main_text(f"<p>one</p><script>{script}<p>two") == "one"


def test_html_class_words_do_not_remove_the_page():
    text = prose(30, 1)
    for page in ("<body class='single no-sidebar'><article>{}</article>", "<html class=has-sidebar><body><main id=comments>{}</main>", "<article class='post comments-open'>{}</article>", "<body><div class='layout sidebar'><div class='related x'><p>{}</p></div></div>"):
        assert html_tree.main_text(page.format(text + "<div class=sidebar>links</div><nav class=menu>" + prose(90, 2) + "</nav>")) == text
    assert html_tree.main_text(f"<div class=comments>{prose(20, 3)}</div><article>{text}</article>") == text
    assert html_tree.main_text(f"<div class='layout sidebar'>{text}</div><article>card</article>") == f"{text}\ncard"


def test_html_on_pages(spark):
    rows = {r.page_id: r.text for r in html_tree.op1_html(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")].replace("<br>", " ").replace("<b>", "")
        parts = [" ".join(html.unescape(x).split()) for x in body.replace("</h1>", "<p>").replace("<h1>", "<p>").replace("</p>", "<p>").split("<p>")]
        assert rows[r.page_id] == "\n".join(x for x in parts if x)


def test_media_round_trip(spark, docs):
    stored = media.media_table(docs).collect()
    for r, d in zip(stored, docs.collect(), strict=True):
        payload, n = media.payload_of(d.text)
        assert media.load(bytes(r.media)) == payload and len(payload) % 576 == 0 and payload[:n] == (d.text or "").encode()


def test_media_resolve_keeps_order_and_captions(spark):
    known = hashlib.sha256(b"x").hexdigest()
    page = f"<p>one</p><figure><img src='media:{known}' alt=a><figcaption>cap &amp; t</figcaption></figure><p>two<img src='media:{'0' * 64}'>three"
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string").select("id", media.interleave(F.col("html")).alias("items"))
    feats = spark.createDataFrame([(known, 7)], "digest string, size int")
    got = {r["id"]: r["items"] for r in media.resolve(df, feats, ["id"]).collect()}
    assert [(x.text, x.caption, x.media and x.media.size) for x in got[1]] == [("one", None, None), (None, "cap & t", 7), ("two", None, None), (None, None, None), ("three", None, None)]
    assert got[2] == []


def test_pipeline_keeps_columns_and_packs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_mixing_follows_its_schedule(spark, docs, monkeypatch):
    """Slots by the points one by one; another schedule gives other slots, and the stage emits documents by slot."""
    def rows():
        return {r.doc_id: (r.start, r.taken, r.first_slot, r.last_slot) for r in mixing.mix(docs, block=64).where("size > 0 and doc_id is not null").collect()}

    before = rows()
    sources = sorted({(r.source is None, r.source): (r.target, round(r.target), r.source_size) for r in mixing.mix(docs, block=64).collect()}.items())
    n = -(-sum(goal for _, (_, goal, _) in sources) // 64)
    upto, bounds = 0.0, []
    for _, (target, _, _) in sources:
        upto += target
        bounds.append(upto)
    slots = collections.defaultdict(list)
    for k in range(n):
        u = k * mixing.STEP % mixing.POINTS / mixing.POINTS
        slots[next(i for i, b in enumerate(bounds) if u < b / upto or i == len(bounds) - 1)].append(k)
    for i, (_, (_, goal, _)) in enumerate(sources):
        blocks = -(-goal // 64)
        slots[i] = slots[i][:blocks] + [n + rank for rank in range(len(slots[i]), blocks)]
    at = {key: i for i, (key, _) in enumerate(sources)}
    for r in docs.where("doc_id is not null").collect():
        if r.doc_id in before and r.doc_id != 7:
            i = at[(r.source is None, r.source)]
            _, goal, whole = sources[i][1]
            start, taken, first, last = before[r.doc_id]
            size = len(r.text.split())
            used = [slots[i][b] for a in (start, start + whole) for b in range(a // 64, (min(a + size, goal) - 1) // 64 + 1) if a < goal]
            assert (first, last) == ((min(used), max(used)) if used else (-1, -1))
    order = [r.doc_id for r in mixing.repeat_documents(docs, block=64).collect() if r.doc_id in before and r.doc_id != 7]
    first = [x for i, x in enumerate(order) if x not in order[:i]]
    assert len(first) > 3 and first[0] == min((x for x in before if x != 7 and before[x][2] >= 0), key=lambda x: before[x][2])
    monkeypatch.setattr(mixing, "STEP", 7)
    assert {k: v[:2] for k, v in rows().items()} == {k: v[:2] for k, v in before.items()} and rows() != before


def test_mixing_sums_a_hot_group(spark):
    """A third of the rows alike in id and size: one row until the end, then rows of their own."""
    df = spark.createDataFrame([(None, "a b c", "s")] * 300 + [(i, "x " * (i % 9), "s") for i in range(600)], "doc_id long, text string, source string")
    got = mixing.mix(df, block=16).collect()
    assert len(got) == 900 and abs(sum(r.taken for r in got) - got[0].target) <= 0.5 and sum(r.doc_id is None for r in got) == 300


def plain_email(x, key):
    name, domain = x.split("@")
    draw = lambda i, half: int(hashlib.sha256(f"{key}:email:{i}:{half}".encode()).hexdigest()[:12], 16)
    halves = [name[: len(name) // 2], name[len(name) // 2 :]]

    def turned(text, other, i):
        out = ""
        for at, c in enumerate(text):
            by, n = draw(i * 1000 + at, other), ord(c)
            low, size = (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if "0" <= c <= "9" else (n - n % 16, 16) if n > 127 else (n, 1)
            out += chr(low + (n - low + by) % size)
        return out

    for i in range(4):
        halves[i % 2] = turned(halves[i % 2], halves[1 - i % 2], i)
    return "".join(halves) + "@" + domain


def plain_pseudonym(x, key=pii.KEY):
    """One find, in plain Python."""
    import datetime as dt
    import re

    d = re.sub(r"\D", "", x)
    fill = lambda digits: "".join(next(it) if c.isdigit() else c for it in [iter(digits)] for c in x)
    if "@" in x:
        return plain_email(x, key)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", x):
        a, g, s = map(int, x.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return x
        v = plain_feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn", key)
        first = v // (99 * 9999)
        return f"{first + 1 + (first >= 665):03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
        try:
            day = (dt.date.fromisoformat(x) - dt.date(1970, 1, 1)).days - pii.FIRST_DAY
        except ValueError:
            return x
        n = pii.DATE_A * pii.DATE_B
        return str(dt.date(1970, 1, 1) + dt.timedelta(plain_feistel(day, pii.DATE_A, pii.DATE_B, "date", key) + pii.FIRST_DAY)) if 0 <= day < n else x
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", x):
        parts = [int(p) for p in x.split(".")]
        v = plain_feistel(int.from_bytes(bytes(parts), "big"), 65536, 65536, "ip", key) if max(parts) < 256 else None
        return x if v is None else ".".join(map(str, v.to_bytes(4, "big")))
    if re.match(r"\d{13,19}$|\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}", x):
        if not luhn(d):
            return x
        n = len(d) - 1
        body = f"{plain_feistel(int(d[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), 'card', key):0{n}d}"
        return fill(next(body + c for c in "0123456789" if luhn(body + c)))
    return fill(d[:-10] + f"{plain_feistel(int(d[-10:]), 10**5, 10**5, 'phone', key):010d}")


def test_pseudonyms_against_plain_python(spark):
    import regex

    draw, texts = random.Random(8), ["ñéü@example.com and Ωmega7@x.gr", "ssn 000-00-0000, 666-12-3456, 123-00-4567, 899-99-9999, 667-01-0001", "on 1900-01-01, 2099-12-31, 2023-02-29", "0.0.0.0 255.255.255.255 256.1.1.1", None, ""]
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    for _ in range(60):
        body = number(15)
        card = next(body + c for c in "0123456789" if luhn(body + c))
        texts.append(f"{prose(5, draw.random())} {draw.choice('Az9')}{number(2)}.{prose(1, draw.random())}@m.example.org, +44 ({number(3)}) {number(3)}-{number(4)}; {number(3)}-{number(2)}-{number(4)} {card} {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}\n{draw.randint(1900, 2099)}-{draw.randint(1, 12):02d}-{draw.randint(1, 31):02d} {draw.randint(0, 300)}.{draw.randint(0, 300)}.1.2 {number(16)}.")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.text for r in pii.hide_private(df).collect()}
    find = regex.compile(pii.ANY)
    assert got == {i: t and find.sub(lambda m: plain_pseudonym(m[0]), t) for i, t in enumerate(texts)}
    assert all(a not in got[0] for a in ("ñéü@", "Ωmega7@"))
    assert got[1].startswith("ssn 000-00-0000, 666-12-3456, 123-00-4567, ") and got[3].endswith("256.1.1.1")


def test_secrets_against_the_contract(spark):
    """The base kinds by the words of the contract, over all documents."""
    import re

    def plain(text):
        out = []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
            out += [("assign", *m.span())] * (len(m[2]) >= 12)
        out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))

    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = secret_scan.op8_secrets(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        want = plain(rows[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secrets_reports_private_structures_only():
    oid, big = der(6, bytes([42, 134, 72, 134, 247, 13, 1, 1, 1])), der(2, b"\1" * 128)
    private = [der(0x30, der(2, b"\0") + big + der(2, b"\1\0\1") + big * 6), der(0x30, der(2, b"\1") + der(4, b"k" * 32)), der(0x30, der(2, b"\0") + der(0x30, oid) + der(4, b"k" * 40)), der(0x30, der(0x30, oid) + der(4, b"k" * 40))]
    public = [der(0x30, big + der(2, b"\1\0\1")), der(0x30, der(0x30, oid + der(5, b"")) + der(3, b"\0" * 140)), der(0x30, der(0x30, big + oid) + der(0x30, oid) + der(3, b"\0" * 128))]
    kinds = lambda raw: [k for _, _, k in secret_scan.spans(f"k {base64.b64encode(raw).decode()} z")]
    assert [kinds(x) for x in private] == [["der"]] * 4 and [kinds(x) for x in public] == [[]] * 3
    blob = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"p" * 32))
    assert kinds(blob) == [] and kinds(b"openssh-key-v1\0" + b"n" * 40) == ["ssh"]
    body = base64.b64encode(public[1]).decode()
    assert secret_scan.spans(f"-----BEGIN PUBLIC KEY-----\n{body}\n-----END PUBLIC KEY-----") == []


def test_language_against_plain_zstandard(spark):
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    books = language.learn(docs)
    assert all(len(b) <= language.DICT_BYTES for b in books.values())
    got = {r.doc_id: (r.lang_pred, round(r.score, 9), r.rejected) for r in language.op7_language(spark, SF).collect()}
    for r in docs.collect():
        raw = language.normalised(r.text)
        sizes = {k: len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(raw)) for k, b in books.items()}
        best = min(sizes, key=lambda k: sizes[k])
        others = [n for k, n in sizes.items() if k != best]
        want = (best, round(1 / sum(2.0 ** (8 * (sizes[best] - n)) for n in sizes.values()), 9), min(others) - sizes[best] < language.MARGIN * sizes[best])
        assert got[r.doc_id] == (want if raw else ("und", 0.0, True))


def test_quality_against_plain_discriminant(spark):
    """Shrunk covariances, their determinants and Mahalanobis distances by numpy, without factors."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    x = np.array([quality.statistics(texts[i]) for i, _ in known])
    y = np.array([k for _, k in known])
    centre, scale, d = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6)), x.shape[1]
    parts = []
    for k in (0, 1):
        z = (x[y == k] - centre) / scale
        cov = np.cov(z.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + (quality.SHRINKAGE * max(np.trace(cov) / d, 1e-3) + 1e-6) * np.eye(d)
        parts.append((z.mean(0), np.linalg.inv(cov), np.log(np.linalg.det(cov)), np.log((y == k).mean())))
    for r in quality.op4_quality(spark, "/root/testdata/sf0.01").collect():
        z = (np.array(quality.statistics(texts[r.doc_id])) - centre) / scale
        log = [prior - 0.5 * (det + (z - m) @ inv @ (z - m)) for m, inv, det, prior in parts]
        assert abs(r.score - 1 / (1 + np.exp(min(500, log[0] - log[1])))) < 1e-6
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_media_query_against_plain_python(spark):
    """Payload, stored form, features, and what the parsed sequence tells: position, items, text around it, caption."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = media.op10_media(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        x = np.frombuffer(payload, np.uint8)
        first = [x[:576].reshape(24, 24)[3 * i : 3 * i + 3, 3 * j : 3 * j + 3].astype(int).sum() for i in range(8) for j in range(8)]
        bits = sum(int(c * 64 > sum(first)) << (63 - i) for i, c in enumerate(first))
        hist = [int(((x >= 32 * i) & (x < 32 * i + 32)).sum()) for i in range(8)]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.feature == f"tiles={len(x) // 576};mean={x.mean():.4f};std={x.std():.4f};hist={','.join(map(str, hist))};hash={bits:016x}"
        lines = [" ".join(line.split()) for line in texts[r.doc_id].split("\n")]
        full = [line for line in lines if line]
        assert (r.position, r.n_items, r.n_text, r.caption) == (int(bool(lines[0])), len(full) + 3, sum(map(len, full)), f"{len(raw)} bytes")
        assert (r.n_media, r.n_unknown, r.positions) == (2, 1, f"{r.position},{len(full) + 1},{len(full) + 2}")
        assert r.captions == f"{len(raw)} bytes|{media.AGAIN}|{media.LOST}"


def test_media_resolve_takes_any_key(spark):
    df = spark.createDataFrame([("k1", "w", "<p>one"), ("k2", None, None)], "digest string, item string, html string").select("digest", "item", media.interleave(F.col("html")).alias("items"))
    got = media.resolve(df, spark.createDataFrame([], "digest string, size int"), ["digest", "item"]).orderBy("digest").collect()
    assert [(r.digest, r["item"], [x.text for x in r["items"]]) for r in got] == [("k1", "w", ["one"]), ("k2", None, [])]


def test_dedup_stage_blank_and_repeated_rows(spark):
    rows = [(1, "\t", "a"), (1, "\t", "b"), (2, "x y", "b"), (2, "x y", "a"), (3, None, "a"), (3, None, "a"), (None, "x z", "c"), (None, "x z", "c")]
    got = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_html_tree_against_plain_python(spark):
    """Importance of every path of two hosts of pages without main elements, from whole pages, by the published formulas."""
    import math

    page = lambda h, i: "<body>" + ("<div class=strip><p>Read more</p><p>All rights</p></div>" if i % 5 else "") + f"<div class=list>{'<ul><li>a</ul>' if i % 2 else '<p>b</p>'}</div><div class=story><p>{prose(9, 50 * h + i)}</p><p>{prose(6, 999 * h + i)}</p></div>"
    rows = [(20 * h + i, f"http://h{h}.example/{i}", page(h, i)) for h in (0, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    low = {r.host: set(r.low) for r in html_tree.low_branches(df.withColumn("host", html_tree.host_of(F.col("url")))).collect()}
    for h in (0, 1):
        seen = collections.defaultdict(dict)
        for n, _, html_ in rows[10 * h : 10 * h + 10]:
            merged = collections.defaultdict(lambda: (set(), set()))
            for path, style, own in html_tree.blocks(html_)[1]:
                merged[path][0].add(style)
                merged[path][1].add(own)
            for path, (styles, own) in merged.items():
                seen[path][n] = (tuple(sorted(styles)), tuple(sorted(own)))

        def entropy(values):
            return -sum(c / len(values) * math.log(c / len(values), 10) for c in collections.Counter(values).values())

        def judge(path):
            styles, own = zip(*seen[path].values())
            kids = [judge(k) for k in seen if k.rpartition("/")[0] == path]
            parts, text = [k[:2] for k in kids], any(any(x) for x in own)
            if text or not kids:
                content = 1 - sum(math.log(c, 10) * c for c in collections.Counter(own).values()) / len(own) if text else 0.0
                parts.append((content, content < html_tree.LOW))
            inner, share = sum(p[0] for p in parts) / len(parts), html_tree.GAMMA ** len(set(styles))
            value = (1 - share) * entropy(styles) + share * inner if kids else inner
            return value, value < html_tree.LOW and all(p[1] for p in parts)

        want = {html_tree.digest(p) for p in seen if judge(p)[1]}
        assert want and low[f"h{h}.example"] == want
    got = {r.page_id: r.text for r in html_tree.extract(df).collect()}
    assert all("Read more" not in t and prose(9, n + 30 * (n // 20)) in t for n, t in got.items())


def test_pipeline_stages_against_plain_python(spark):
    """Every stage on its own input, small: the discriminant's verdict, classes by all pairs, plain pseudonyms, plain streams, plain ids."""
    import regex
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    assert list(stages) == ["quality", "near_duplicates", "private", "mixing", "packing"]
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = {r.doc_id: r.score for r in quality.op4_quality(spark, SF).collect()}
    assert {r.doc_id for r in seen["quality"]} == {i for i, x in score.items() if x >= quality.THRESHOLD}
    rows = sorted(seen["quality"], key=lambda r: r.doc_id)
    idf = minhash.inverse_frequencies(all_docs.where(F.col("doc_id").isin([r.doc_id for r in rows])))
    sets = [minhash.shingles(minhash.word_hashes(r.text), idf) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and minhash.alike(sets[i], sets[j]) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == [rows[i].doc_id for i in sorted(set(group))]
    find = regex.compile(pii.ANY)
    want = {r.doc_id: find.sub(lambda m: plain_pseudonym(m[0]), r.text) for r in seen["near_duplicates"]}
    assert {r.doc_id: r.text for r in seen["private"]} == want
    size = {r.doc_id: len(r.text.split()) for r in seen["private"]}
    count = collections.Counter(r.doc_id for r in seen["mixing"])
    goals = {r.source: r.goal for r in mixing.targets(spark.createDataFrame([(r.source, size[r.doc_id]) for r in seen["private"]], "source string, size long")).collect()}
    for source, goal in goals.items():
        own = [r for r in seen["private"] if r.source == source]
        order = sorted((r for r in own if size[r.doc_id]), key=lambda r: hashlib.md5(f"{mixing.SEED}{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest())
        whole, at = sum(size[r.doc_id] for r in own), 0
        for r in order:
            assert count[r.doc_id] == (at < goal) + (at + whole < goal)
            at += size[r.doc_id]
    tk = Tokenizer.from_file(packing.vocabulary())
    tokens = collections.Counter()
    for r in seen["packing"]:
        tokens[r.doc_id] += r.length
    text = {r.doc_id: r.text for r in seen["mixing"]}
    assert tokens == {i: n * (len(tk.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in count.items()}
