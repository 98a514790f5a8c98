"""Toxicity, language, url rules and piece segmentation."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from beaconry.llm import langid, linkgraph, nbest, toxicity

FOLDER = "/root/testdata/sf0.01"


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled():
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rnd.choices("bcdfgaeiou", k=6)) for _ in range(rnd.choice([10, 40, 200]))]
        bad = i % 5 == 0
        if bad:
            for _ in range(1 + len(w) // 60):
                w[rnd.randrange(len(w))] = rnd.choice(["zorkface", "zorkling", "Qu1xxy", "quixxy", "qυіxxy"])
        elif i % 7 == 0:
            w[0] = "zorkfruit"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_matches_and_holds_out(spark, docs, labelled):
    rows, labels = labelled
    rows = [*rows, (5000, None), (5001, ""), (None, "zorkface " * 3), (5002, "ok " * 50_000 + "zorkface"), (5003, "zorkface you zorkling"), (5003, "zorkface you zorkling")]
    df = docs(*rows)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, lab)
    got = [r.asDict() for r in toxicity.judged(df, model).collect()]
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    wrong = [g for g in got if g["doc_id"] in truth and g["predicted"] != truth[g["doc_id"]]]
    assert not wrong
    by = {g["doc_id"]: g for g in got}
    assert by[5000]["score"] == by[5001]["score"] == 0 and by[5003]["predicted"] == 1
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    assert all(g["held_out"] == is_held(g["doc_id"]) for g in got if g["doc_id"] is not None)
    clean = toxicity.drop_toxic(df, model)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.where("doc_id < 900").collect()) == [i for i in range(900) if not truth[i]]
    # held-out labels are not looked at
    flipped = spark.createDataFrame([(i, q, 1 - t if is_held(i) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert toxicity.learn(df, flipped) == toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs((1, "zorkface"), (2, None))
    assert [r.score for r in toxicity.judged(df, toxicity.learn(df, none)).collect()] == [0, 0]
    assert toxicity.judged(docs(), toxicity.learn(docs(), none)).count() == 0
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs(*[(i, f"t {i}") for i in range(20)]), one)["terms"] == {}


def test_folding_and_exceptions():
    assert toxicity.fold("IdіОt 1d10T!") == " idiot idiot "
    assert toxicity.fold("Ça—b") == " ca b "
    m = toxicity.Matcher({" trash": 2.0, " scum ": 3.0}, [toxicity.fold("trash can")])
    assert m.measure("Trash, tr4sh trashcan; trash can. Scum scummy") == (2.0 * 3 + 3.0, 7)
    assert m.measure("") == (0.0, 0)
    # brute force over words
    rnd = random.Random(2)
    for _ in range(50):
        words = [rnd.choice(["trash", "can", "scum", "trashy", "x"]) for _ in range(12)]
        want = 0.0
        for a, b in zip(words, [*words[1:], ""]):
            want += 2.0 * (a.startswith("trash") and not (a == "trash" and b == "can")) + 3.0 * (a == "scum")
        assert m.measure(" ".join(words))[0] == want


def test_folding_keeps_other_scripts():
    assert toxicity.fold("кот") == " kot " and toxicity.fold("你好 плохой") == " \x1f你\x1f好 плoxoи ".replace("плoxoи", toxicity.fold("плохой").strip())
    assert toxicity.fold("плохой").strip() and len(toxicity.fold("плохой")) == 8
    assert toxicity.fold("abc坏人def") == " abc \x1f坏\x1f人 def " and toxicity.fold("سيئ!") .count(" ") == 2
    assert toxicity.fold("हिन्दी") == " हिन्दी " and toxicity.fold("나쁜 놈") == " 나쁜 놈 "
    m = toxicity.Matcher({"\x1f坏\x1f人": 2.0, " 나쁜": 1.0, " ox ": 4.0}, [toxicity.fold_phrase("坏人卡")])
    assert m.measure("他是坏人。坏人卡 나쁜놈 ox oxen") == (2.0 + 1.0 + 4.0, 4 + 3 + 1 + 2)
    assert m.measure_all(pa.array(["他是坏人。坏人卡 나쁜놈 ox oxen", None, "坏 人"])) == [(7.0, 10), (0.0, 0), (0.0, 2)]


@pytest.mark.parametrize("alphabet, bad, gap", [("бгджзилпфцчшщэюя", "гадюшный", " "), ("ابتثجحخدذرزسشصضطظعغفق", "قذارتك", " "),
                                                ("的一是不了在有和这中大为上个国我以要他时来用们", "蠢猪", ""), ("bcdfgaeiou", "oik", " ")])
def test_toxicity_in_other_scripts_and_short_words(spark, docs, alphabet, bad, gap):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rnd.choices(alphabet, k=rnd.choice([2, 3, 5, 7]))) for _ in range(rnd.choice([8, 30]))]
        if i % 4 == 0:
            words[rnd.randrange(len(words))] = bad
        rows.append((i, gap.join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    model = toxicity.learn(docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.judged(docs(*rows), model).collect()}
    assert [i for i in got if got[i] != (i % 4 == 0)] == []
    assert model["terms_left_out"] == 0
    cut = toxicity.learn(docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_terms=1)
    assert cut["terms_left_out"] >= 0 and len(cut["terms"]) <= 1


def test_language(spark, docs):
    rnd = random.Random(3)
    syll = {"aa": ["ka", "to", "mi"], "bb": ["sch", "un", "ge"], "cc": ["ção", "ñe", "ll"]}
    rows = [(i, " ".join("".join(rnd.choices(s, k=rnd.randrange(1, 5))) for _ in range(30)), lang)
            for i, (lang, s) in enumerate([x for _ in range(60) for x in syll.items()])]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 -- !", None), (903, "katomi " * 60_000, None), (904, "zzz qqq", None), (None, "unge", "aa"), (903, "schun", None)]
    df = docs(*rows)
    model = langid.learn(df)
    got = {(r.doc_id, i): r for i, r in enumerate(langid.predict(df, model).collect())}
    assert len(got) == len(rows)
    for (i, _), r in got.items():
        if i is not None and i < 180:
            assert r.lang_pred == rows[i][2] and r.held_out == is_held(i)
        if i in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    flipped = docs(*[(i, t, "bb" if i is not None and is_held(i) else l) for i, t, l in rows])
    assert {k: {w: v.tolist() for w, v in langid.learn(flipped)[k].items()} for k in ("words",)} == {
        k: {w: v.tolist() for w, v in model[k].items()} for k in ("words",)}
    assert langid.predict(docs(), langid.learn(docs())).count() == 0
    untaught = docs((1, "hello"))
    assert [r.lang_pred for r in langid.predict(untaught, langid.learn(docs())).collect()] == ["und"]


def test_language_backs_off_in_order():
    model = {"langs": ["a", "b"], "words": {"known": np.array([0, -5], np.float32)},
             "grams": [{"n": np.array([-9, -1], np.float32)}, {"kn": np.array([-1, -9], np.float32)}, {}, {"^kno": np.array([-7, -2], np.float32)}]}
    s = langid.Scorer(model)
    assert s.word_vector("known").tolist() == [0, -5]
    assert s.word_vector("knob").tolist() == [-7, -2]  # a 4-gram beats all shorter ones
    assert s.word_vector("akn").tolist() == [-1, -9]
    assert s.word_vector("n").tolist() == [-9, -1]
    assert s.word_vector("zz").tolist() == [0, 0]


def test_rules_against_plain_python(spark, tmp_path):
    urls = [None, "", "nohost", "http://", "HTTP://Example.NET/en/x?y=/en/", "https://a.example.net/en/", "http://example.net/EN/", "x://net/", "x://internet/",
            "http://b.EXAMPLE.com/de/1#top", "http://example.com/de", "http://xexample.com/de/", "http://s.org/fr/?q", "http://org/fr/", "http://s.org/en/fr/",
            "http://a/b://net/", "//net/", "http://ex.net?x=/en/", "http://ex.net#a", "http://Ünet.net/", "http://a.example.net/en/\nx"]
    rows = [(i, u, None) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    got = {r.page_id: r for r in linkgraph.judge(spark.read.parquet(str(tmp_path / "p"))).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [(h + p, v) for v, h, p in linkgraph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit, key=lambda f: len(f[0])) if fit else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0]), u
        assert got[i].verdict in ("allow", "block") and (rule[1] is None or got[i].verdict == rule[1])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert linkgraph.judge(empty).count() == 0


def test_ranks_equal_dense_iteration(spark):
    rnd = random.Random(4)
    n = 25
    edges = [(f"h{rnd.randrange(n)}", f"h{rnd.randrange(n)}", float(rnd.randrange(1, 4))) for _ in range(80)]
    edges = [e for e in {(a, b): (a, b, w) for a, b, w in edges}.values() if e[0] != e[1]]
    seeds = [("h1", 2.0, 0.0), ("h2", 1.0, 0.0), ("h7", 0.0, 5.0), ("lonely", 0.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in linkgraph.propagate(
        spark.createDataFrame(edges, "src string, dst string, weight double"),
        spark.createDataFrame(seeds, "host string, trust double, distrust double"), tolerance=1e-9, max_rounds=200).collect()}
    names = sorted({x for a, b, _ in edges for x in (a, b)} | {s[0] for s in seeds})
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        m[at[a], at[b]] = w
    for k, flow in ((1, m), (2, m.T)):
        seed = np.zeros(len(names))
        for s in seeds:
            seed[at[s[0]]] = s[k]
        seed /= seed.sum()
        share = flow / np.maximum(flow.sum(axis=1, keepdims=True), 1e-300)
        rank = seed.copy()
        for _ in range(300):
            rank = 0.15 * seed + 0.85 * rank @ share
        for h in names:
            assert got.get(h, (0.0, 0.0))[k - 1] == pytest.approx(rank[at[h]], abs=1e-6)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = '<a href="{}">x</a>'
    pages = [(1, "http://bad.net/x", None), (2, "http://fan.com/a", link.format("http://bad.net/") + link.format("//BAD.net/y")),
             (3, "http://good.org/fr/1", link.format("https://friend.com/")), (4, "http://friend.com/z", None),
             (5, "http://other.com/q", "<a href=/local>"), (5, "http://other.com/q", "<a href=/local>")]
    got = {r.page_id: r.verdict for r in linkgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_verdicts_do_not_depend_on_unrelated_pages(spark):
    """Blocked hosts elsewhere, one as large as 300 million pages, move neither ranks nor verdicts."""
    link = '<a href="{}">x</a>'
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(
        [(1, "http://bad.net/x", None), (2, "http://fan.com/a", link.format("http://bad.net/") + link.format("http://friend.com/")),
         (3, "http://good.org/fr/1", link.format("https://friend.com/")), (4, "http://friend.com/z", None), (5, "http://far.com/z", link.format("//fan.com"))], schema)
    padding = spark.range(20_000).selectExpr("100 + id", "concat('http://h', id % 7, '.padding.net/', id)", "cast(null as string)")
    seen = [{r.page_id: (r.verdict, r.trust, r.distrust) for r in linkgraph.judge(p).where("page_id < 100").collect()} for p in (pages, pages.union(padding))]
    assert {i: r[0] for i, r in seen[0].items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    for i, (verdict, *ranks) in seen[0].items():
        assert seen[1][i][0] == verdict and seen[1][i][1:] == pytest.approx(ranks, rel=1e-3)

    edges = spark.createDataFrame([("fan.com", "bad.net", 1.0)], "src string, dst string, weight double")
    hosts = "host string, trust double, distrust double"
    far = spark.createDataFrame([("bad.net", 0.0, 1.0), ("huge.net", 0.0, 3e8)], hosts)
    got = {r.host: r.distrust for r in linkgraph.propagate(edges, far, scaled=False, least=1e-7).collect()}
    assert got["fan.com"] == pytest.approx(0.85 * 0.15) and got["bad.net"] == pytest.approx(0.15)
    none = linkgraph.propagate(edges.limit(0), far, scaled=False).collect()
    assert {r.host: r.distrust for r in none}["bad.net"] == pytest.approx(0.15)


def dense_verdicts(pages, links):
    """Verdicts by plain Python: pages (id, host, rule verdict or None), links {(host, host): weight}."""
    hosts = sorted({h for _, h, _ in pages} | {h for e in links for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    m, seed = np.zeros((len(hosts), len(hosts))), np.zeros((2, len(hosts)))
    for (a, b), w in links.items():
        m[at[a], at[b]] = w
    m = 0.7 * m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
    for h in hosts:
        said = [v for _, x, v in pages if x == h]
        lead = (said.count("allow") - said.count("block")) / max(len(said), 1)
        seed[0 if lead > 0 else 1, at[h]] = abs(lead)
    eye = np.eye(len(hosts))
    trust, distrust = np.linalg.solve(eye - m.T, seed[0]), np.linalg.solve(eye - m, seed[1])
    return {i: v or ("block" if distrust[at[h]] >= 0.3 * (1 + trust[at[h]]) else "allow") for i, h, v in pages}, trust, distrust, at


def test_verdicts_equal_dense_ranks(spark):
    rnd = random.Random(9)
    hosts = [f"h{i}x" + rnd.choice([".net", ".info", ".info", ".info"]) for i in range(24)] + ["t1.org", "t2.org"]
    pages, links, rows = [], {}, []
    for i in range(90):
        h = rnd.choice(hosts)
        said = "block" if h.endswith(".net") else "allow" if h.endswith(".org") else None
        to = [rnd.choice(hosts) for _ in range(rnd.randrange(4))]
        for t in set(to) - {h}:
            links[h, t] = links.get((h, t), 0) + 1
        pages.append((i, h, said))
        rows.append((i, f"http://{h}/fr/{i}", " ".join(f'<a href="http://{t}/">' for t in to)))
    want, trust, distrust, at = dense_verdicts(pages, links)
    got = linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == want and {"allow", "block"} == {want[i] for i, _, v in pages if v is None}
    for r in got:
        assert (r.trust, r.distrust) == pytest.approx((trust[at[r.host]], distrust[at[r.host]]), rel=1e-2, abs=1e-3)


def test_a_trace_of_distrust_blocks_nobody(spark):
    """One link out of many, and five hops, stay allowed; a host that mainly links to blocked hosts goes, however many do."""
    link = '<a href="http://{}/">x</a>'
    rows = [(0, "http://a.net/", None), (1, "http://big.com/", link.format("a.net") + "".join(link.format(f"ok{i}.com") for i in range(20)))]
    rows += [(10 + i, f"http://spam{i}.com/", link.format("a.net") * 3) for i in range(50)]
    rows += [(100 + i, f"http://hop{i}.info/", link.format("a.net" if i == 1 else f"hop{i - 1}.info")) for i in range(1, 6)]
    rows += [(200, "http://mixed.com/", link.format("a.net") + link.format("spam1.com") + link.format("ok1.com")),
             (201, "http://seed.org/fr/", link.format("vouched.com")), (202, "http://vouched.com/", link.format("a.net") + link.format("ok1.com"))]
    # names of the operator's own columns in the input change nothing
    frame = spark.createDataFrame([(*r, "x", 9.0, 7) for r in rows], "page_id long, url string, html string, host string, trust double, allowed int")
    got = {r.page_id: r.verdict for r in linkgraph.judge(frame).collect()}
    assert got[0] == "block" and got[1] == "allow"
    assert all(got[10 + i] == "block" for i in range(50))
    assert [got[100 + i] for i in range(1, 6)] == ["block", "block", "block", "allow", "allow"]
    assert got[200] == "block" and got[201] == got[202] == "allow"


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return nbest.Encoder(MODEL, 5)


def all_paths(lattice, text):
    out = [[] for _ in range(len(text) + 1)]
    out[0] = [(0.0, ())]
    for end in range(1, len(text) + 1):
        out[end] = [(s + score, ids + piece) for start, score, piece in lattice.arcs_to(text, end) for s, ids in out[start]]
    return out[-1]


def test_n_best_equals_all_paths(coder):
    rnd = random.Random(5)
    lattice = coder.lattice
    for _ in range(40):
        text = "".join(rnd.choices("the anding▁ré\n", k=rnd.randrange(1, 9)))
        paths = sorted((-s for s, _ in all_paths(lattice, text)))[:5]
        got = lattice.n_best(text, 5)
        assert [-s for s, _ in got] == pytest.approx(paths)
        assert len({ids for _, ids in got}) == len(got)
        best, ids, loss = lattice.best(text)
        assert best == pytest.approx(-paths[0]) and loss == pytest.approx(paths[1] - paths[0] if len(paths) > 1 else float("inf"))


def test_whole_texts_equal_search_in_the_whole_lattice(coder):
    rnd = random.Random(6)
    for _ in range(25):
        text = "".join(rnd.choices(["the ", "thing", "  ", "é", "\n", "x,", " and", "ß."], k=rnd.randrange(1, 9)))
        whole = nbest.SPACE + text.replace(" ", nbest.SPACE)
        got = next(coder.encode(pa.array([text])))
        assert [s for s, _ in got] == pytest.approx([s for s, _ in coder.lattice.n_best(whole, 5)])
        for score, ids in got:
            assert nbest.decode(ids, coder.lattice.bytes_of) == text
            every = {tuple(p): s for s, p in all_paths(coder.lattice, whole)} if len(whole) < 14 else None
            if every:
                assert every[tuple(np.frombuffer(ids, "<u4").tolist())] == pytest.approx(score)


def test_many_segments_at_once_equal_one_by_one(coder):
    rnd = random.Random(8)
    parts = ["".join(rnd.choices("the andingré▁,\n日", k=rnd.randrange(1, 30))) for _ in range(400)] + ["a" * 40]
    for part, (score, ids, loss) in zip(parts, coder.lattice.best_many(parts)):
        one = coder.lattice.best(part)
        assert (score, tuple(np.frombuffer(ids, "<u4").tolist()), loss) == one
    texts = ["The thing, and.", "", "日本 é\n x", "a"]
    cut = coder.segments(pa.array(texts)).to_pylist()
    assert ["".join(c) for c in cut] == [(nbest.SPACE + t.replace(" ", nbest.SPACE)) if t else "" for t in texts]
    for segment in [s for c in cut for s in c]:
        assert not any(len(p) > 1 and coder.lattice.cuts(np.frombuffer(p.encode("utf-32-le"), "<u4")).any()
                       for p in [segment])


def test_least_sums():
    rnd = random.Random(7)
    for _ in range(30):
        lists = [sorted([0.0] + [float(rnd.randrange(9)) for _ in range(rnd.randrange(4))]) for _ in range(rnd.randrange(5))]
        want = sorted(sum(c) for c in itertools.product(*lists))[:4]
        assert [s for s, _ in nbest.least_sums(lists, 4)] == want


def test_segments_of_documents(docs, coder):
    rows = [(1, "The thing and the other."), (2, None), (3, ""), (4, "日本 😀 \x00"), (5, "ab" * 30_000), (6, "word " * 40_000), (6, "x"), (None, "null id"), (7, "a ▁b")]
    got = nbest.segment(docs(*rows), MODEL, 3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r.ids) == r.n_pieces and list(r.scores) == sorted(r.scores, reverse=True)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.piece_crc32[0]
        assert r.round_trip == (r.doc_id != 7)
    assert {r.doc_id: r.n_pieces for r in got}[2] == 0
    assert nbest.segment(docs(), MODEL, 3).count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = {i: sp.encode(t or "") for i, t in rows if i != 6}
    for r in got:
        assert r.same_as_model == (list(r.ids) == list(r.model_ids)) and zlib.crc32(np.array(r.model_ids, "<u4").tobytes()) == r.model_crc32
        if r.doc_id != 6:
            assert list(r.model_ids) == plain[r.doc_id]
    clash = docs(*rows).selectExpr("doc_id", "text", "1 as id", "2 as n", "'x' as scores")
    assert sorted(nbest.segment(clash, MODEL, 3).select("model_crc32").collect()) == sorted((r.model_crc32,) for r in got)


def test_scores_are_log_frequencies_and_best_paths_are_likeliest(spark):
    """Over the given documents: counts, the model's own ids and the best path against plain Python."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = {i: sp.encode(t) for i, t in texts.items()}
    counts = np.full(sp.get_piece_size(), 0.5) + np.bincount([p for ids in own.values() for p in ids], minlength=sp.get_piece_size())
    scores = nbest.piece_scores(rows, MODEL)
    assert scores == pytest.approx(np.log(counts / counts.sum()))
    got = nbest.segment(rows, MODEL, 4).collect()
    assert len(got) == len(texts)
    lattice = nbest.Lattice(MODEL, scores)
    agree = alike = total = 0
    for r in got:
        assert list(r.model_ids) == own[r.doc_id] and r.round_trip
        known = [i for i in own[r.doc_id] if not sp.is_byte(i)]
        if len(known) == len(own[r.doc_id]) and known:  # the model's own path is one of the lattice's
            assert r.scores[0] >= scores[known].sum() - 1e-6 * len(known)
        agree += r.same_as_model
        alike += len(set(r.ids) & set(r.model_ids))
        total += len(set(r.model_ids))
    assert alike / max(total, 1) > 0.6
    print("documents alike", agree / len(got), "pieces alike", alike / total)
    for text in itertools.islice(filter(None, texts.values()), 3):
        whole = nbest.SPACE + text[:400].replace(" ", nbest.SPACE)
        assert next(nbest.Encoder(MODEL, 4, scores).encode(pa.array([text[:400]])))[0][0] == pytest.approx(lattice.n_best(whole, 1)[0][0])


def test_equal_scores_give_different_segmentations():
    flat = np.full(32_000, -5.0)
    coder = nbest.Encoder(MODEL, 6, flat)
    for text in ("thing", "the other", "abab cdcd"):
        runs = next(coder.encode(pa.array([text])))
        assert len({ids for _, ids in runs}) == len(runs) == 6
        paths = sorted((-s for s, _ in all_paths(coder.lattice, nbest.SPACE + text.replace(" ", nbest.SPACE))))[:6]
        assert [-s for s, _ in runs] == pytest.approx(paths)
