"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from vocalis.llm import fim, linededup, turnrepair


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11


def fim_of(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


FIM_TEXTS = ["", None, "\n", "a", "a\n", "\n\n", "é\nß😀\n\nx", "no mark <P <S< >\n<", "a<P>b\nc", "x<<M>\n", "<S>", "y\n<" + "P>", "l1\nl2\n" * 40, "long " * 60, "\n" * 99 + "end", "a <P\n> b\n" * 9]


def test_functions_compose_like_reading_on():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("<PSM>\na") for _ in range(rng.randrange(12))).encode()
        whole = fim.scan(text)
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        left, right = fim.IDENTITY, fim.IDENTITY
        for x in parts:
            left = fim.compose(left, fim.scan(x))
        for x in reversed(parts):
            right = fim.compose(fim.scan(x), right)
        assert left == right == whole
        assert whole[1][0] == text.count(b"\n") and (whole[0][0] % fim.MARKS == 3) == (re.search(b"<[PSM]>", text) is not None)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 16])
def test_fill_in_middle(spark, chunk):
    rows = [(i, t, "x", 1) for i, t in enumerate(FIM_TEXTS * 3)] + [(None, "no\nid\n", "x", 1), (4, "other\ntext\nof 4", "x", 1), (12, FIM_TEXTS[12], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_h string, N int")
    made = fim.fill_in_middle(docs, chunk=chunk)
    assert made.columns == ["doc_id", "text", "fim_h", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored("output", "form")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(r[:2] for r in rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_of(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_fill_in_middle_blocks_and_empty_table(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "\n", "é", "<", "P"]) for _ in range(1500)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fim.fill_in_middle(docs, chunk=5).collect()  # 300 and more chunks: two blocks
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == [(i, *fim_of(i, t)) for i, t in enumerate(texts)]
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
    plain = fim.fill_in_middle(docs, rate=0).collect()
    assert all(r.form == "plain" and r.output == texts[r.doc_id] for r in plain)


# ---- 12


def lines_of(texts, min_docs, min_chars=1):
    space, lower = " \t\n\v\f\r", str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(space).translate(lower)
    split = [(t or "").split("\n") for t in texts]
    count = collections.Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    out = []
    for lines in split:
        stay = [x for x in lines if count[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    h, f = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(0, 1 << 32, 20_000).astype(np.uint32)
    h[7], h[8] = h[5], h[6]  # equal hashes, told apart by their fingerprints
    counts = rng.integers(1, 70_000, 20_000)
    index = linededup.ShardIndex.load(linededup.ShardIndex.build(h, f, counts).dump())
    assert (index.count(h, f) == counts).all()
    assert len(index.prints) + index.rest.shape[1] == len(h) and index.rest.shape[1] == 4
    assert sum(len(b) for b in index.bits) * 8 < len(h) * 0.6
    assert not index.count(h + np.uint64(1), f).any()
    nothing = linededup.ShardIndex.load(linededup.ShardIndex.build(h[:0], f[:0], counts[:0]).dump())
    assert not nothing.count(h[:5], f[:5]).any()


@pytest.mark.parametrize(("min_docs", "min_chars", "hot", "shard_keys"), [(10, 1, 4096, 1 << 16), (3, 1, 1, 16), (3, 4, 5, 7), (1, 0, 2, 50)])
def test_lines_equal_brute_force(spark, min_docs, min_chars, hot, shard_keys):
    rng = random.Random(5)
    pool = [f" Line {i % 60} é{'x' * (i % 5)}\t" for i in range(90)] + ["", "  ", "A", "a ", "É", "é", "common"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(200)] + ["", None, "\n", "common\r\ncommon", "Common " * 1, "x\n" * 5000, "common"]
    rows = [(i if i % 9 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "again", 2), (3, texts[3], "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_row string, N_LINES int")
    kept = linededup.drop_repeated_lines(docs, min_docs, min_chars, hot, shard_keys)
    assert kept.columns == ["doc_id", "text", "line_row", "n_lines", "n_dropped", "kept_text"]
    want = collections.Counter((r[0], r[1], *x) for r, x in zip(rows, lines_of([r[1] for r in rows], min_docs, min_chars), strict=True))
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in kept.collect()) == want


def test_lines_of_an_empty_table(spark):
    assert linededup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- 13

COST = {"I": 2, "R": 2, "D": 3, "K": 0}


def cheapest(rows):
    """The least (cost, audit) of rows (role, must be deleted, truncated) by strings, and the repaired turns."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    due = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def closed(ways):
        ways = dict(ways)
        for _ in range(4):
            for s, (cost, audit, turns) in list(ways.items()):
                new = (cost + 2, audit + "I", (*turns, (due[s], "")))
                if after[s] not in ways or new[:2] < ways[after[s]][:2]:
                    ways[after[s]] = new
        return ways

    ways = {0: (0, "", ())}
    for role, text, must, cut in rows:
        # insertions don't replace a state's best before the row is read: all strings of up to two are tried
        nxt = {}
        for s0, (cost0, audit0, turns0) in ways.items():
            s, cost, audit, turns = s0, cost0, audit0, turns0
            for _ in range(4):
                options = [("D", s, turns)]
                if not must:
                    options.append(("R", after[s], (*turns, (due[s], text))))
                    kept = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                    if kept:
                        options.append(("K", kept, (*turns, (role, text))))
                for letter, to, out in options:
                    new = (cost + COST[letter] + (cut and letter != "D"), audit + letter, out)
                    if to not in nxt or new[:2] < nxt[to][:2]:
                        nxt[to] = new
                cost, audit, turns, s = cost + 2, audit + "I", (*turns, (due[s], "")), after[s]
        ways = nxt
    ways = closed(ways)
    return min((ways[s] for s in (0, 3) if s in ways), key=lambda w: w[:2])


def conversations_of(rows):
    out, groups = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        groups[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, found = set(), collections.Counter()
        rows = []
        for _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            found[fault] += 1
            rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, left = cheapest(rows)
        out[conv] = (gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left)))
    return out


def all_edits(rows):
    """Every (cost, audit) of rows with up to two insertions at each place."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def go(i, s, run):
        if run < 2:
            for c, a in go(i, after[s], run + 1):
                yield c + 2, "I" + a
        if i == len(rows):
            if s in (0, 3):
                yield 0, ""
            return
        role, _, must, cut = rows[i]
        for c, a in go(i + 1, s, 0):
            yield c + 3, "D" + a
        if not must:
            for c, a in go(i + 1, after[s], 0):
                yield c + 2 + cut, "R" + a
            kept = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
            if kept:
                for c, a in go(i + 1, kept, 0):
                    yield c + cut, "K" + a

    return min(go(0, 0, 0))


def test_cheapest_edits_of_short_conversations():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "u", "tool", ""]), "x", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        rows = [(r, t, must, cut and not must) for r, t, must, cut in rows]
        kinds = [(r[:1], "blank" if must else "truncated" if cut else "") for r, _, must, cut in rows]
        macros, end, cost = turnrepair.edits(kinds)
        tail = turnrepair.TAIL[end]
        assert (cost + 2 * tail, "".join(macros) + "I" * tail) == all_edits(rows) == cheapest(rows)[:2]


def test_tables_combine_in_any_grouping():
    rng = random.Random(4)
    for _ in range(60):
        kinds = [(rng.choice("usat"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(60))]
        cuts = sorted(rng.randrange(len(kinds) + 1) for _ in range(3))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True)]
        combined = turnrepair.Combined.new()
        for p in parts:
            combined.add(*turnrepair.summary(p))
        path, cost = combined.way()
        macros, end, own = turnrepair.edits(kinds)
        assert cost == own + 2 * turnrepair.TAIL[end] and path[-1][1] == end
        assert macros == [m for p, (a, b) in zip(parts, path, strict=True) for m in turnrepair.edits(p, a, b)[0]]


def turn_rows():
    rng = random.Random(6)
    text = lambda: rng.choice(["Hi.", "Well?", "cut off", " ", "\n\t", "ok!", "é\nß.", f"{rng.random()}."])
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice([text(), text(), None])) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(1000, t % 300, ("user", "assistant")[t % 2], f"Turn {t % 200}{'.' if t % 3 else ''}") for t in range(900)]
    rows += [(None, t, "user", "Null.") for t in range(40)] + [(2000, None, None, None)] * 3 + [rows[4]] * 30
    gone = next(c for c in range(3000, 9000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (1,)))
    return [*rows, (gone, 1, "user", "Gone.")], gone


@pytest.mark.parametrize("piece_rows", [4096, 7, 1])
def test_repair_equals_brute_force(spark, piece_rows):
    rows, gone = turn_rows()
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    made = turnrepair.repair_conversations(turnrepair.damage_turns(table), piece_rows)
    got = {r.conv: tuple(r)[1:] for r in made.report.collect()}
    want = conversations_of(rows)
    assert got == want and made.report.count() == len(want)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", sha(""))
    turns = collections.defaultdict(list)
    for r in sorted(made.turns.collect(), key=lambda r: (r.part, r.seq)):
        turns[r.conv] += [f"{t.role}:{t.text}" for t in r.turns]
    assert {c: sha("\n".join(t)) for c, t in turns.items()} == {c: w[-1] for c, w in want.items()}


def test_repair_of_an_empty_table(spark):
    table = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert turnrepair.repair_conversations(turnrepair.damage_turns(table)).report.collect() == []
