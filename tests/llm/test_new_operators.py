"""Turn repair, compression scores and the Merkle manifest against brute force, with nulls, ties and repeats."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tracemill.llm import compressed_size, merkle_labels, turn_repair
from tracemill.llm.compressed_size import fit, quality_scores, score
from tracemill.llm.merkle_labels import manifest
from tracemill.llm.turn_repair import repair, repair_turns

MARK = re.compile(r"[^\x20\x09-\x0D]")


def conversations():
    rng = np.random.default_rng(5)
    rows = []
    for conv in range(40):
        for turn in range(int(rng.integers(1, 9))):
            role = str(rng.choice(["user", "assistant", "system", "tool", "", "s"], p=[0.42, 0.38, 0.08, 0.06, 0.03, 0.03]))
            text = str(rng.choice(["Yes.", "No", " \n", "", "Where? é", "wait... \t", "日本。"]))
            rows.append((conv, turn * int(rng.integers(1, 3)), role, text))
    rows += [(50, None, "user", "a."), (50, None, None, "b."), (50, 3, "assistant", None), (50, 3, "assistant", None), (51, None, "user", "x")]
    rows += [(None, 1, "user", "n."), (None, 2, "assistant", "m."), (None, None, "user", "n.")]
    rows += [(60, int(k), ["user", "assistant"][k % 2] if k % 7 else "system", f"t{k % 11}.") for k in range(90)]
    rows += [(70, 4, "user", "same.")] * 60 + [(71, 1, "user", "y" * 300_000 + ".")]
    return rows


def expected(rows):
    """Every row's fate by plain Python; the cheapest edits by trying states with strings of letters."""
    out, per = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        per[conv] += []
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
            per[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for conv, found in per.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in found:
            marks = MARK.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        best = {"": (0, "", ())}  # initials so far, told apart by their last -> cost, letters, rows

        def offer(to, last, path):
            if last not in to or path[:2] < to[last][:2]:
                to[last] = path

        def follow(last, initial):
            return initial == "s" if last == "" and initial == "s" else initial == ("a" if last == "u" else "u")

        def inserted(states):
            states = dict(states)
            for _ in range(2):
                for last, (cost, letters, kept) in list(states.items()):
                    role = "assistant" if last == "u" else "user"
                    offer(states, role[0], (cost + 5, letters + "I", (*kept, f"{role}:")))
            return states

        for (_, role, text), fault in zip(found, faults):
            to = {}
            for last, (cost, letters, kept) in inserted(best).items():
                offer(to, last, (cost + 2, letters + "D", kept))
                if fault not in ("blank", "duplicate"):
                    extra = 5 * (fault == "truncated")
                    if role and follow(last, role[0]):
                        offer(to, role[0], (cost + extra, letters + "K", (*kept, f"{role}:{text}")))
                    new = "assistant" if last == "u" else "user"
                    offer(to, new[0], (cost + extra + 1, letters + "R", (*kept, f"{new}:{text}")))
            best = to
        cost, letters, kept = min(v for k, v in inserted(best).items() if k in ("", "a"))
        count = Counter(faults)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("size", "tasks"), [(256, 1), (3, 5), (1, 8)])
def test_turn_repair(spark, size, tasks):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, copies string, at int")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = {r.conv_id: tuple(r)[1:] for r in repair_turns(table.repartition(4), size).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = expected(rows)
    assert got == want
    assert repair_turns(table.limit(0), size).count() == 0


def test_turn_repair_sql(spark):
    rows = [r for r in conversations() if r[0] not in (60, 70, 71)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toArrow()
    con = duckdb.connect()
    con.register("conversations", frame)
    assert {r[0]: tuple(r[1:]) for r in con.execute(turn_repair.sql()).fetchall()} == expected(rows)


def test_repair_of_long_conversations(spark):
    """A conversation cut into many segments, its weights joined by halves."""
    rng = np.random.default_rng(8)
    rows = [(1, k, str(rng.choice(["user", "assistant", "system"])), f"w{rng.integers(0, 3000)}{rng.choice(['.', ''])}", 1) for k in range(4000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    one = repair(table, 5000).collect()
    assert one == repair(table.repartition(6), 16).collect()
    kept = [r.split(":")[0][0] for r in one[0].audit.replace("D", "").replace("I", "u") if ":" in r]
    assert not kept and one[0].audit.count("I") <= 1 + one[0].cost // 5


def documents():
    rng = np.random.default_rng(9)
    rows = [(int(k), f"s{k % 3}" if k % 11 else None, "en", int(k), "\n".join(f"w{x}" for x in rng.integers(0, 50, 6))) for k in range(3000)]
    rows += [(7, "s1", "en", 7, "again")] * 3 + [(None, "s1", None, None, None), (None, None, "de", 3, "x\ny"), (9000, "lone", "de", 0, ""),
             (9001, "é", None, 5, "long\n" * 50_000), (9002, "", "fr", 1, "y")]
    return rows


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, source, lang, n_chars, text = row
    parts = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return digest(*["-" if p is None else f"{len(p.encode())}:{p}" for p in parts])


def proofs(digests):
    """Root and, for each leaf, its (left, right) siblings from the lowest level up."""
    paths, level, own = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for k, at in enumerate(own):
            run = at // 3 * 3
            paths[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        level, own = [digest(*level[a : a + 3]) for a in range(0, len(level), 3)], [at // 3 for at in own]
    return level[0], paths


@pytest.mark.parametrize("tier", [6, 2, 1])
def test_manifest(spark, tier, monkeypatch):
    monkeypatch.setattr(merkle_labels, "TIER", tier)
    rows = documents()
    if tier == 1:
        rows = rows[::7] + rows[-8:]
    per = defaultdict(list)
    for r in rows:
        per[r[1]].append(r)
    names = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    roots, want = {}, Counter()
    built = {}
    for name in names:
        own = sorted(per[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        roots[name], built[name] = None, (own, *proofs([leaf(r) for r in own]))
        roots[name] = built[name][1]
    root, tops = proofs([roots[n] for n in names])
    for name, top in zip(names, tops):
        for row, path in zip(built[name][0], built[name][2]):
            path, given = path + top, leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                given = leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in path:
                given = digest(left, given, right)
            want[row[0], leaf(row), roots[name], root, digest(*[a + b for a, b in path]), given, given == root] += 1
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int")
    assert Counter(map(tuple, manifest(table.repartition(5)).collect())) == want
    assert manifest(table.limit(0)).count() == 0
    if tier == 6:
        con = duckdb.connect()
        con.register("documents", table.toArrow())
        assert Counter(con.execute(merkle_labels.SQL).fetchall()) == want


def labelled():
    rng = np.random.default_rng(21)
    rows, labels = [], []
    for k in range(1200):
        bad = k % 4 == 0
        pool = [f"zz{x}!!" for x in range(300)] if bad else [f"word{x}" for x in range(300)]
        rows.append((k, "en", " ".join(rng.choice(pool, int(rng.integers(5, 200))))))
        if k % 3 < 2:
            labels.append((k, int(not bad), 0))
    rows += [(None, "en", "word1 word2"), (5000, "en", None), (5001, "en", ""), (5002, "en", "word5 " * 60_000), (3, "en", "again"), (3, "en", "again")]
    return rows, [*labels, (6000, 1, 0), (2, 0, 0), (None, 1, 0), (10, None, 0)]


def test_compressed_size(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([(*r, 0.5, "y") for r in rows], "doc_id long, lang string, text string, score double, label string").repartition(5)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    out = quality_scores(docs, marks).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    truth = {k: q for k, q, _ in labels if k != 2}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([p == q for p, q in held]) > 0.97
    again = {(r.doc_id, r.score) for r in quality_scores(docs.repartition(3), marks.repartition(2)).collect()}
    assert again == {(r.doc_id, r.score) for r in out}
    model, whole = fit(docs, marks), {r.doc_id: r.score for r in out}
    for doc_id, _, text in [*rows[20:60], rows[-3]]:
        assert abs(model.probability(difference(text, model)) - whole[doc_id]) < 1e-12
    assert quality_scores(docs.limit(0), marks).count() == 0


def difference(text, model):
    """Bytes saved for each byte, by compressions of each block."""
    good, bad = compressed_size._compressor(model.good), compressed_size._compressor(model.bad)
    data = text.encode()
    blocks = [data[a : a + 512] for a in range(0, len(data), 512)]
    return sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks) / len(data)


def test_compressed_size_without_labels(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    ones = spark.createDataFrame([r for r in labels if r[1] == 1], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality_scores(docs, ones).collect()} == {1}
    assert {r.score for r in quality_scores(docs, ones.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    marks = lambda held: spark.createDataFrame(
        [(k, 1 - q if held and k is not None and zlib.crc32(str(k).encode()) % 5 == 0 and q is not None else q, t) for k, q, t in labels], "doc_id long, quality int, toxic int")
    assert fit(docs, marks(False)) == fit(docs, marks(True))
    assert score(docs, fit(docs, marks(False)), 2.0).filter("predicted = 1").count() == 0
