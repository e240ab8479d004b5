"""Each operator against brute force, an exact round trip or held-out labels, and on edge cases."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vocalis.llm import bpe, components, embeddings, fingerprints, html, jaccard, licenses, packing, substring, tokenfile, toxicity
from vocalis.llm.pretokens import LibraryEncoder, read_tokenizer
from vocalis.llm.shingles import shingle_set
from vocalis.llm.workspace import Workspace

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", None, "a", "ΑΣ ΣΑΣ İstanbul", "x<|endoftext|>y <|startoftext|>", "x²½ ٣٤ 中文 한국어 é", "ab" * 3000, "it's I'M ''s", "😀 a\t\n  b   \n", "J̌x", "\x1c\x85\xa0 a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (2, "a", "again", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, rep string, n int")


@pytest.fixture(scope="module")
def sample():
    return [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]


def unsigned(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_the_library(path, sample):
    content = read_tokenizer(path)
    lib, own, cached = Tokenizer.from_str(content), bpe.ForcedBoundaryBPE(content), LibraryEncoder(content)
    for t in [*sample[:60], *(x for x in ODD if x), *(chr(c) + "a" + chr(c) for c in range(1, 0x3000, 7))]:
        ids = lib.encode(t, add_special_tokens=False).ids
        raw, decoded = own.encode(t)
        assert unsigned(raw) == ids and unsigned(cached.encode(t)) == ids
        assert decoded == lib.decode(ids, skip_special_tokens=False) == own.decode(ids)


def test_bpe_digests(odd):
    got = bpe.bpe_digests(odd, WORD).collect()
    lib = Tokenizer.from_file(WORD)
    assert len(got) == len(ODD) + 2
    for r in got:
        if r.doc_id is not None:
            ids = lib.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def check_packing(rows, texts):
    lib = Tokenizer.from_file(WORD)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids, at = [*lib.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad


def test_packing(spark, sample):
    texts = dict(enumerate([*sample, "", None, "word " * 9000]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("offset", __import__("pyspark").sql.functions.lit("x"))
    rows = packing.pack_sequences(df, WORD).collect()
    assert check_packing(rows, texts) <= 0.005 * sum(r.length for r in rows)
    assert packing.pack_sequences(df.limit(0), WORD).count() == 0


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32 - 1, n), rng.integers(0, 900, n)).astype("<u4")
        docs = [(7, ids[: n // 3].tobytes()), (7, b""), (9, ids[n // 3 :].tobytes())]
        assert [(a, b) for a, _, b in tokenfile.decode_file(tokenfile.encode_file(docs))] == docs
    with pytest.raises(ValueError):
        list(tokenfile.decode_file(b"x" * 80))


def test_token_files(spark, sample):
    texts = dict(enumerate([*sample[:50], "", None]))
    df = spark.createDataFrame([(i * 5, t) for i, t in texts.items()] + [(None, "no id")], "doc_id long, text string")
    lib, at = Tokenizer.from_file(BYTE), 0
    got = {r.doc_id: r for r in tokenfile.token_file_digests(df, BYTE).collect()}
    for i, t in texts.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[i * 5]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_report(odd, none).collect()
    assert len(got) == len(ODD) + 2 and all(r.score == 0 for r in got)
    model = toxicity.train(["you idiot fool"] * 20 + ["kind words here"] * 20, [1] * 20 + [0] * 20, [1.0] * 40, toxicity.ToxicityParams(min_z=1))
    assert model.score("such an idiiot") > model.score("such kindly words")
    long = "kindidiot" * 5000
    assert model.word(long) == pytest.approx(float(model.weight[toxicity.ngram_ids(long, model.params)].mean(dtype="f8")))


def test_html():
    page = '<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy &amp; sell</div><article><h1>Head</h1><p><b>First&nbsp; line<br><p>Second <i>in</i>line</article><div id=comments><article><p>A reader says a lot about it all</p></article></div><footer>foot</footer><script>if (a<b) x("</p>")'
    assert html.main_text(page) == "Head\nFirst line\nSecond inline"
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("plain") == "plain"
    plain = "<div><a href=1>Menu one</a></div><div>" + "long text here " * 10 + "</div><p>Short end.</p>"
    assert html.main_text(plain).endswith("Short end.") and "Menu" not in html.main_text(plain)


def test_html_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text.startswith(r.text.split("\n")[0]) and r.n_chars == len(r.text) and "©" not in r.text and r.n_chars > 0


def test_licences(spark):
    texts = ["Released under the MIT License. Under the MIT license!", "the Apache License, Version 2.0", "CC-BY_NC, cc by nc", "", None, "MIT License", "licensed under the GNU General Public License, version 3.", "unter the mit lizenz é ÄB"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import re

    for r in licenses.scan_licences(df).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or ""))
        places = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if r.doc_id == 6:
            assert r.labels == "gpl-3" and r.score == 0.75


def test_fingerprints(spark, odd):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "no id")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert sorted(got) == list(range(len(ODD)))
    for i, t in enumerate(ODD):
        t, nxt = t or "", ODD[(i + 1) % len(ODD)] or ""
        q = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1 and got[i].n_chars == len(t)
    assert len(fingerprints.fingerprint_documents(odd).collect()) == len(ODD)
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0


def test_winnowing_by_hand(spark):
    from pyspark.sql import functions as F

    words = [f"w{random.Random(i).randrange(6)}" for i in range(60)]
    r = spark.createDataFrame([(" ".join(words),)], "t string").select(fingerprints.grams(F.col("t")).alias("g"), fingerprints.winnow(F.col("t")).alias("k")).first()
    want = []
    for i in range(len(r.g) - 3):
        hashes = [x >> 26 for x in r.g[i : i + 4]]
        at = max(j for j in range(4) if hashes[j] == min(hashes))
        if r.g[i + at] not in want:
            want.append(r.g[i + at])
    assert r.k == want


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()
    assert all(find(r.node) == r.component for r in got)
    assert {r.node for r in got} == {x for p in links for x in p if p[0] != p[1]}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    vecs = np.concatenate([base, base[:12] + rng.normal(size=(12, 16)) * 0.25, base[:6] + rng.normal(size=(6, 16)) * 0.35, base[:3]])
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vecs)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, [1.0] * 16, None)]
    rows += [(1000 + i, [float(x) for x in base[0] * (1 + i)], 0) for i in range(400)]
    got = {r.vec_id: r for r in embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = [r for r in rows if r[1] and None not in r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    m = np.array([r[1] for r in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    lab = np.array([r[2] for r in ok])
    near = (m @ m.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    assert [got[r[0]].n_links for r in ok] == near.sum(axis=1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906)) and len(got) == len(rows)
    assert all(r.component_id <= r.vec_id and r.kept == (r.component_id == r.vec_id) for r in got.values())


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_equals_brute_force(spark, k, num, den):
    rng, vocab, texts = random.Random(3), [f"w{i}" for i in range(400)], []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 11, 13, 16, 20, 30, 60, 200]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    docs = [(3 * i, t) for i, t in enumerate([*texts, "", None, "a b", "A  b"])]
    sets = {i: set(shingle_set(t, k).tolist()) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*docs, (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.jaccard_components(df, k, num, den).collect()}
    assert got.pop(None).component_id is None
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_compact_windows_are_the_large_nodes_of_the_tree():
    rng = np.random.default_rng(0)
    for _ in range(10):
        h = rng.integers(0, 500, rng.integers(46, 300)).astype(np.uint64)
        c, left, right = substring.compact_windows(h, 46)
        want = set()
        for i in range(len(h)):
            a, b = i, i
            while a > 0 and h[a - 1] > h[i] and i - a < 127:
                a -= 1
            while b + 1 < len(h) and h[b + 1] >= h[i] and b - i < 127:
                b += 1
            if b - a + 1 >= 46:
                want.add((i, a, b))
        assert set(zip(c.tolist(), left.tolist(), right.tolist(), strict=True)) == want


def test_repeated_passages(spark):
    rng, vocab = random.Random(3), [f"w{i}" for i in range(3000)]
    passage, docs, where = [rng.choice(vocab) for _ in range(60)], [], {}
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(30, 300))]
        if i % 10 == 0:
            p, k = list(passage), rng.randrange(len(w))
            if i % 20:
                p[rng.randrange(5, 55)] = "zzz"
            w[k:k] = p
            where[i] = k
        docs.append((i, "\n".join(w), "x"))
    docs += [(500, "", None), (501, None, None), (None, " ".join(passage), None)]
    got = {r.doc_id: r for r in substring.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string, n string")).collect()}
    for i in range(120):
        spans = [(s.start, s.end) for s in got[i].repeated]
        if i in where and i:
            assert len(spans) == 1 and abs(spans[0][0] - where[i]) <= 6 and abs(spans[0][1] - where[i] - 60) <= 6
            assert got[i].kept_text.split() == docs[i][1].split()[: spans[0][0]] + docs[i][1].split()[spans[0][1] :]
        else:
            assert spans == [] and got[i].kept_text == docs[i][1]
    assert got[501].kept_text is None and got[None].kept_text == docs[-1][1] and len(got) == len(docs)


def test_exact_repeats_within_edited_copies(spark):
    """Every run of 51 words that a smaller document has is covered, however much the rest was edited."""
    rng, vocab, docs = random.Random(5), [f"w{i}" for i in range(5000)], []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(200, 900))]
        for copy in range(3):
            w = list(base)
            at = rng.randrange(len(w) - 120)
            for i in range(len(w)):
                if copy and not at <= i < at + 90 and rng.random() < 0.15:
                    w[i] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    got = {r.doc_id: r.repeated for r in substring.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen: set = set()
    want = met = 0
    for i, t in docs:
        w, need = t.split(), set()
        runs = [tuple(w[p : p + 51]) for p in range(len(w) - 50)]
        for p, r in enumerate(runs):
            if r in seen:
                need.update(range(p, p + 51))
        seen.update(runs)
        want += len(need)
        met += len(need & {x for s in got[i] for x in range(s.start, s.end)})
    assert want > 2000 and met >= 0.99 * want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert i == 3 or kept.columns == docs.columns
        docs = kept
    assert docs.count() > 0


def test_passages_whose_phrases_stand_in_smaller_documents(spark):
    """Stock phrases in small documents, and a passage at a later place of its first document, hide no repeat."""
    rng, vocab = random.Random(8), [f"w{i}" for i in range(20000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, docs = some(60), []
    for i in range(40):
        w = some(20)
        for k in range(56):
            w += [*passage[k : k + 5], *some(15)]
        docs.append((i, " ".join(w)))
    docs += [(100, " ".join([*some(200), *passage, *some(100)])), (101, " ".join([*some(90), *passage, *some(70)]))]
    got = {r.doc_id: [(s.start, s.end) for s in r.repeated] for r in substring.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got.pop(101) == [(90, 150)]
    assert not any(got.values())


def test_near_passages_of_least_likeness(spark):
    """Every pair of planted passages whose shingle sets are just alike by brute force is found."""
    rng, vocab = random.Random(11), [f"w{i}" for i in range(20000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, where = [], {}
    for i in range(600):
        p = some(52)
        q = list(p)
        q[rng.randrange(20, 32)] = "zzz"
        a, b = (set(shingle_set(" ".join(x), 5).tolist()) for x in (p, q))
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
        before = some(rng.randrange(20, 200))
        where[1000 + i] = len(before)
        docs += [(i, " ".join([*some(rng.randrange(20, 200)), *p, *some(60)])), (1000 + i, " ".join([*before, *q, *some(60)]))]
    got = {r.doc_id: [(s.start, s.end) for s in r.repeated] for r in substring.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum((at, at + 52) in got[i] for i, at in where.items()) >= 598
    assert not any(got[i] for i in range(600))


def test_licences_of_a_bundle():
    """Each template that stands in a text in full is found, whatever else the text has."""
    index = licenses.LicenceIndex({}, 0)
    whole = [t for _, t, _ in licenses.TEMPLATES]
    _, scores = index.scan(licenses.words_of(" xx ".join(whole)))
    assert scores == {label: 1.0 for label, _, _ in licenses.TEMPLATES}
    # brute force over all places, with two fifths of the words changed and the changed words elsewhere
    rng = random.Random(4)
    for _ in range(300):
        words = []
        for t in rng.sample(whole, 5):
            seq = t.split()
            gone = rng.sample(range(len(seq)), rng.randrange(0, len(seq) * 2 // 5 + 1))
            words += [f"x{i}" if i in gone else w for i, w in enumerate(seq)] + rng.sample(seq, len(seq))
        want: dict = {}
        for label, seq, keys in index.templates:
            for start in range(1 - len(seq), len(words)):
                hit = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(seq)) / len(seq)
                found = words[max(0, start) : start + len(seq)]
                if hit >= 0.6 and all(any(found[i : i + len(k)] == k for i in range(len(found))) for k in keys):
                    want[label] = max(want.get(label, 0), hit)
        places, scores = index.scan(words)
        assert scores == {**want, **{label: 1.0 for _, label in places}}


def test_html_of_pages_whose_frame_looks_like_furniture():
    body = "<nav><a href=x>Home</a></nav><article><h1><a href=y>A title</a></h1><p>Some text of it.</p><p><a href=z>One link</a></p></article><footer>foot</footer>"
    want = "A title\nSome text of it.\nOne link"
    for frame in ('<html class="cookie-consent"><body class="single has-sidebar">{}', '<main class="widget-area">{}</main>', '<body><form id="search">{}</form>'):
        assert html.main_text(frame.format(body)) == want
    assert html.main_text(body.replace("<article>", '<article class="has-sidebar">').replace("<p>Some", '<article class="comment"><p>A reader</p></article><p>Some')) == want
    assert html.main_text("<body><form><div>" + "long text here " * 10 + "</div><p>Short end.</p></form>").endswith("Short end.")
    assert html.main_text("<main hidden>" + body + "</main>") == ""


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_of_letters_newer_than_pythons_tables(path):
    import unicodedata

    content = read_tokenizer(path)
    lib, own, cached = Tokenizer.from_str(content), bpe.ForcedBoundaryBPE(content), LibraryEncoder(content)
    for c in (0x1C89, 0xA7CB, 0xA7DA, 0x105C2, 0x1E5F0, *range(0x250, 0x32000, 97)):
        if unicodedata.category(chr(c)) == "Cn":
            t = f"ab {chr(c)}c{chr(c)} 'S {chr(c)}1"
            ids = lib.encode(t, add_special_tokens=False).ids
            assert unsigned(own.encode(t)[0]) == unsigned(cached.encode(t)) == ids


def test_passages_of_whole_copies_and_clashing_columns(spark):
    rng = random.Random(2)
    text, short = (" ".join(f"w{rng.randrange(900)}" for _ in range(k)) for k in (51, 50))
    rows = [(1, text), (2, text), (2, "other words"), (3, short), (4, short), (5, f"a {text} b")]
    df = spark.createDataFrame([(i, t, "c", "r") for i, t in rows], "doc_id long, text string, cand string, repeated string").withColumn("span_doc", __import__("pyspark").sql.functions.lit(7))
    got = {(r.doc_id, r.text): [(s.start, s.end) for s in r.repeated] for r in substring.near_duplicate_passages(df).collect()}
    assert got == {(1, text): [], (2, text): [(0, 51)], (2, "other words"): [], (3, short): [], (4, short): [], (5, f"a {text} b"): [(1, 52)]}


def test_fragments_leave_linked_pairs_a_common_one():
    """Pairs that are just alike enough share a signature, whatever their size."""
    rng = np.random.default_rng(6)
    for num, den in ((90, 100), (8, 10)):
        sim = jaccard.Similarity(num, den)
        for size in (4, 5, 9, 10, 17, 30, 60, 100, 200, 400, 1000, 5000):
            for _ in range(20):
                both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                total = size
                while size * den >= num * (total + 1):
                    total += 1
                extra = rng.integers(0, 1 << 63, total - size, dtype=np.uint64)
                cut = rng.integers(0, len(extra) + 1)
                a, b = (np.unique(np.concatenate([both, x])) for x in (extra[:cut], extra[cut:]))
                if len(extra):
                    assert len(np.intersect1d(jaccard.signatures(a, sim), jaccard.signatures(b, sim)))

def test_near_passages_behind_smaller_documents_that_are_less_alike(spark):
    """A passage with one word edited is found though smaller documents hold it with four words edited."""
    for versions in (0, 5, 30):
        rng, vocab = random.Random(30 + versions), [f"w{i}" for i in range(20000)]
        some = lambda n: [rng.choice(vocab) for _ in range(n)]
        docs, where, at = [], {}, 0
        for i in range(60):
            p = some(60)
            for k in range(versions):
                q = list(p)
                for x in rng.sample(range(60), 4):
                    q[x] = f"v{k}"
                docs.append((1000 * i + k, " ".join([*some(30), *q, *some(30)])))
            q = list(p)
            q[rng.randrange(20, 40)] = "zzz"
            before = some(rng.randrange(20, 90))
            docs += [(100_000 + i, " ".join([*some(40), *p, *some(40)])), (200_000 + i, " ".join([*before, *q, *some(40)]))]
            where[200_000 + i] = len(before)
        got = {r.doc_id: [(s.start, s.end) for s in r.repeated] for r in substring.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        found = sum(any(a <= at + 2 and b >= at + 58 for a, b in got[i]) for i, at in where.items())
        assert found >= 57, (versions, found)


def test_near_passages_between_many_documents_that_are_less_alike(spark):
    """The one alike document is neither the smallest nor among the last before: 12 less alike ones stand before it, 12 behind."""
    rng, vocab = random.Random(77), [f"w{i}" for i in range(20000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, where = [], {}
    for i in range(40):
        p = some(60)
        for k in range(24):
            q = list(p)
            for x in rng.sample(range(60), 5):
                q[x] = f"v{k}"
            docs.append((1000 * i + k + (0 if k < 12 else 200_000), " ".join([*some(30), *q, *some(30)])))
        q = list(p)
        q[rng.randrange(25, 35)] = "zzz"
        before = some(rng.randrange(20, 90))
        docs += [(100_000 + i, " ".join([*some(40), *p, *some(40)])), (300_000 + i, " ".join([*before, *q, *some(40)]))]
        where[300_000 + i] = len(before)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.repeated] for r in substring.near_duplicate_passages(df).collect()}
    assert sum(any(a <= at + 2 and b >= at + 58 for a, b in got[i]) for i, at in where.items()) >= 39


def test_token_blocks_of_every_width_with_few_operations_on_single_bits(monkeypatch):
    """All widths come back; unpacking makes no array of single bits."""
    rng = np.random.default_rng(8)
    files = []
    for w in range(33):
        ids = rng.integers(0, 1 << w, 1000, dtype=np.uint64).astype(np.uint32)
        files.append((ids, *tokenfile.pack_blocks(ids, 1.0)))
        assert files[-1][1]["width"].max() == w
    monkeypatch.setattr(np, "unpackbits", None)
    for ids, table, payload, extra in files:
        assert (tokenfile.unpack_blocks(table, np.frombuffer(payload, np.uint8), extra)[: len(ids)] == ids).all()


def test_less_alike_documents_hide_no_near_passage(spark):
    """Whatever is found without them is found between one to three smaller documents that are less alike, which stand first for some functions only."""
    rng, vocab = random.Random(41), [f"w{i}" for i in range(20000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, others, where = [], [], {}
    for i in range(300):
        p = some(60)
        for k in range(1 + i % 3):
            q = list(p)
            for x in rng.sample(range(60), 6):
                q[x] = f"v{k}"
            others.append((1000 * i + k + (200_000_000 if k == 1 else 0), " ".join([*some(30), *q, *some(30)])))
        q = list(p)
        q[rng.randrange(20, 40)] = "zzz"
        before = some(rng.randrange(20, 90))
        docs += [(100_000_000 + i, " ".join([*some(40), *p, *some(40)])), (300_000_000 + i, " ".join([*before, *q, *some(40)]))]
        where[300_000_000 + i] = len(before)

    def found(rows):
        got = {r.doc_id: [(s.start, s.end) for s in r.repeated] for r in substring.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        return {i for i, at in where.items() if any(a <= at + 2 and b >= at + 58 for a, b in got[i])}

    alone = found(docs)
    assert len(alone) >= 290 and not alone - found(docs + others)


def test_alike_parts_of_many_stretches():
    """Against all pairs of stretches; some parts have more than 64 of them."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 40, 300, 700):
        for _ in range(20):
            at = np.cumsum(rng.choice([1, 1, 1, 1, 1, 2, 3], n)) + 10
            place = np.cumsum(rng.choice([1, 1, 1, 1, 1, 1, 2, 6 if rng.random() < 0.5 else 1], n))
            if n > 50 and rng.random() < 0.5:
                place = np.roll(place, 17)
            edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 1)) + 1
            first, last = np.r_[0, edge], np.r_[edge, len(at)] - 1
            pairs = [(a, b) for a, b in zip(first, last, strict=True) if b - a >= 2]
            want = set()
            for i in range(len(pairs)):
                both = 0
                for j in range(i, len(pairs)):
                    (a, _), (x, b) = pairs[i], pairs[j]
                    both += b - x + 1
                    mine, theirs = at[b] - at[a] + 1, place[b] - place[a] + 1
                    if mine + 4 > 50 and theirs >= both >= 0.8 * (mine + theirs - both):
                        want.add((int(at[a]), int(at[b])))
            got = list(substring._alike_parts(at, place, 50, 0.8))
            assert set(got) <= want and substring.merge_spans(got) == substring.merge_spans(list(want))


def test_merges_look_up_pairs_beside_them_only():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    own = bpe.ForcedBoundaryBPE(read_tokenizer(BYTE))
    own.ranks = Counted(own.ranks)
    merged = own._merge(list("internationalizations"))
    assert "".join(merged) == "internationalizations" and own.ranks.asked <= 3 * 21


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_go_to_the_model_as_they_are(path):
    """Pieces are normalised and split already; doing so again took most of the time of op2 and op9."""
    own, lib = LibraryEncoder(read_tokenizer(path)), Tokenizer.from_file(path)
    assert own._encode("AB") != own._encode("ab") and unsigned(own._encode("ab")) == lib.encode("ab", add_special_tokens=False).ids
    assert unsigned(own._encode("ab cd")) == [t.id for t in lib.model.tokenize("abĠcd")]


def test_the_fit_holds_few_texts_at_once():
    """The driver's memory of the fit: n-grams of all pairs of text and word are not there at once."""
    import tracemalloc

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 10))) for _ in range(5000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(400)]
    y = np.arange(400) % 2
    tracemalloc.start()
    doc, gram, weight = toxicity._design(texts, y, toxicity.ToxicityParams(min_z=0.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(doc) == len(gram) == len(weight) > 400 * 400
    assert peak < 100e6, peak


def test_the_pipeline_cuts_passages_between_many_documents_that_are_less_alike(spark):
    import corpus_pipeline

    rng, vocab = random.Random(78), [f"w{i}" for i in range(20000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, late = [], {}
    for i in range(10):
        p = some(60)
        for k in range(24):
            q = list(p)
            for x in rng.sample(range(60), 5):
                q[x] = f"v{k}"
            docs.append((1000 * i + k + (0 if k < 12 else 200_000), " ".join([*some(30), *q, *some(30)])))
        q = list(p)
        q[30] = "zzz"
        before, after = some(50), some(40)
        docs += [(100_000 + i, " ".join([*some(40), *p, *some(40)])), (300_000 + i, " ".join([*before, *q, *after]))]
        late[300_000 + i] = 150
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert out.columns == ["doc_id", "text"]
    left = {r.doc_id: len(r.text.split()) for r in out.collect()}
    assert sum(left[i] <= n - 56 for i, n in late.items()) >= 9


def test_a_common_line_names_no_documents_that_share_nothing_else(spark, monkeypatch):
    """Of the documents of a very common line, only those come as others that have as many of a window's tokens as a passage needs."""
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    line, template = some(14), some(90)
    docs = [(i, " ".join([*some(60), *line, *some(60)])) for i in range(200)]
    for i in range(1000, 1130):
        w = [*template[:45], *line, *template[45:]]
        docs.append((i, " ".join(x if x in line or rng.random() < 11 / 12 else some(1)[0] for x in w)))
    named, plain = [], substring._all_pairs

    def noted(windows, n, *args):
        pairs = plain(windows, n, *args)
        named.extend(np.frombuffer(b"".join(bytes(r.others) for r in pairs.collect()), substring.STRETCH)["other"].tolist())
        return pairs

    monkeypatch.setattr(substring, "_all_pairs", noted)
    substring.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert named and min(named) >= 1000


def test_tasks_of_token_files_give_memory_back(spark, tmp_path, monkeypatch):
    """Workers that write or read token files return what they don't need before the next task."""
    told = str(tmp_path / "told")

    def noted():
        with open(told, "a") as f:
            f.write("x")

    monkeypatch.setattr(tokenfile, "give_back", noted, raising=False)
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    got = tokenfile.token_file_digests(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))
    # at least one task each that writes and reads
    with open(told) as f:
        assert len(f.read()) >= 2


def test_candidates_within_repeated_words_are_not_looked_at(monkeypatch):
    rng = np.random.default_rng(3)
    limits = (50, 10, 0.8)
    calls = []
    plain = substring.verified_spans
    monkeypatch.setattr(substring, "verified_spans", lambda *a: calls.append(a) or plain(*a))
    for known in ([], [(10, 75)]):
        s = rng.integers(1, 1 << 60, 400).astype(np.uint64)
        near = s[100:190].copy()
        near[40] = 7
        other = [(100, 200, s[100:190].tobytes()), (90, 210, near.tobytes()), (120, 185, s[110:180].tobytes()), (20, 60, s[20:60].tobytes()), (300, 420, s[300:400].tobytes()), (300, 380, s[300:400].tobytes())]
        want = substring.merge_spans([*known, *(x for lo, hi, g in other for x in plain(s, lo, hi, np.frombuffer(g, np.uint64), *limits))])
        calls.clear()
        assert substring.all_verified(s, other * 2, known, *limits) == want
        assert len(calls) < len(other) and all((lo, hi) != (300, 380) for _, lo, hi, *_ in calls)
