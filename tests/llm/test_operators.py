"""Every operator on edge cases, against brute force where its result is exact."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bytelode.llm import bpe, fingerprint, licenses, lm, packing, pii, pretoken, quality, simhash, store, topk, toxicity

from .conftest import documents, sentence

ROWS = [(r[0], r[1] or "") for r in documents()]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_row(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


# 1
def test_licenses(docs, none):
    want = []
    for i, text in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            parts = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licenses.scan(docs).collect()
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert {r["labels"] for r in got if r["doc_id"] == 15} == {"gpl,gpl-3.0"}
    assert licenses.scan(none).collect() == []


def test_license_suppression(spark):
    text = "licensed under the GNU Lesser General Public License version 2.1"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["labels"] == "gpl,lgpl-2.1"  # the general licence's name lies within the lesser's notice; the base label stays


def rule_texts(words):
    """Texts that a rule's words match: without and with what is optional, and by the first and last of each choice."""
    for optional in (False, True):
        for choice in (0, -1):
            text = words.replace("licen[sc]e", "license").replace("[0-9]+", "4").replace("[0-9]{2}", "20")
            while "(?:" in text:
                text = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and not optional else m[1].split("|")[choice], text, count=1)
            yield re.sub(r"(.)\?", r"\1" if optional else "", text)


def test_license_gate(spark, monkeypatch):
    """The scan says the same with and without its gate, for texts that match each rule."""
    texts = [(k, t.upper().replace(" ", ", ") if k % 2 else t) for k, (_, _, words, _, _) in enumerate(licenses.rules()) for t in rule_texts(words)]
    assert all(re.search(licenses.whole_words(w), " ".join(re.findall("[a-z0-9]+", t.lower()))) for (k, t) in texts for w in [licenses.rules()[k][2]])
    names = ["Distributed under the BSD 3-Clause", "Released under the MIT terms", "Available under Apache 2.0", "This work is CC BY-SA 4.0", "CC0 1.0 Universal", "WTFPL", "FreeBSD", "nothing of the kind, mit under"]
    frame = spark.createDataFrame(texts + [(1000 + k, t) for k, t in enumerate(names)], "doc_id long, text string")
    gated = licenses.scan(frame).collect()
    monkeypatch.setattr(licenses, "GATE", "")
    assert sorted(gated, key=repr) == sorted(licenses.scan(frame).collect(), key=repr)
    assert all(r["labels"] for r in gated if r["doc_id"] < 1000)
    assert {r["doc_id"]: r["labels"] for r in gated if r["doc_id"] >= 1000 and r["labels"]} == {1000: "bsd-3-clause", 1002: "apache-2.0", 1001: "mit", 1003: "cc-by-sa-4.0", 1004: "cc0-1.0", 1005: "wtfpl", 1006: "bsd-2-clause"}


# 2
def test_topk(spark):
    rows = [(i, [math.sin(i * 7 + j) * (3 if i % 9 == 0 else 1) for j in range(10)]) for i in range(130)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 10), (203, [float("inf")] * 10), (220, [0.5] * 3), (None, [1.0] * 10), (240, [])]
    rows += [(9, [2.0] * 10), (9, [2.0] * 10), (40, [-1.0] * 10)]  # repeated rows, of a candidate and of a query
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a in sorted({i for i, _ in q if i % 20 == 0}):
        scores = sorted((-sum(x * y for x, y in zip(v, w)), b) for i, v in q if i == a for b, w in q if b != a)[:20]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(scores)]
    assert by_row(topk.top_k(frame).collect(), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(frame.limit(0)).collect() == []
    assert topk.top_k(frame.where("vec_id in (20, 60)")).count() == 2


def test_topk_scores_few_pairs(monkeypatch):
    """The cutoff spares most pairs their whole score, and loses none of the best."""
    import numpy as np
    import pandas as pd

    rng, scored = np.random.default_rng(2), []
    centres = rng.integers(-40, 40, (30, 64))
    vectors = (centres[rng.integers(0, 30, 3000)] + rng.integers(-6, 7, (3000, 64))).astype(np.int8)
    asked = np.arange(0, 3000, 20)
    exact = topk.exact
    monkeypatch.setattr(topk, "exact", lambda q, c, rows, cols: scored.append(len(rows)) or exact(q, c, rows, cols))
    block = {"qb": 0, "q_nth": 0, "q_ids": asked, "q_vectors": vectors[asked].tobytes(), "q_width": 64, "q_kind": "i1"}
    pairs = [block | {"c_ids": np.arange(a, a + 1000), "c_vectors": vectors[a : a + 1000].tobytes(), "c_width": 64, "c_kind": "i1"} for a in (0, 1000, 2000)]
    first = pd.concat(topk.met(iter([pd.DataFrame(pairs)]), 20, False))
    best = first.groupby("query_id")["score"].min()
    known = [p | {"known_ids": best.index.to_numpy(), "known": best.to_numpy()} for p in pairs]
    found = pd.concat(topk.met(iter([pd.DataFrame(known)]), 20, True))
    whole = vectors[asked].astype(int) @ vectors.T.astype(int)
    whole[np.arange(len(asked)), asked] = -(10**9)
    assert sorted(found["score"].tolist()) == sorted(np.sort(whole, axis=1)[:, -20:].reshape(-1).tolist())
    assert sum(scored[:3]) < 0.15 * whole.size and sum(scored[3:]) < 0.15 * whole.size


# 3
def test_quality(docs, labels, none):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["quality"] <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(none, labels).collect() == [] and quality.keep_good(none, labels).collect() == []
    assert {r["evidence"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_sparse_sites_are_shrunk(spark):
    rows = [(i, "big", "p", 0.9) for i in range(200)] + [(1000, "small", "p", 0.1)]
    believed = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    known = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000, 0)], "doc_id long, good int")
    rate = {r["host"]: r["path_rate"] for r in quality.sites(believed, known).collect()}
    assert rate["big"] > 0.9 and 0.5 < rate["small"] < rate["big"]


@pytest.mark.parametrize("most", [3, 10, 40])
def test_samples_at_their_bounds(spark, most):
    """Just above the bound, around where a threshold begins to serve, and far above."""
    for n in (0, most, most + 1, int(1.2 * most) + 199, int(1.2 * most) + 200, int(1.2 * most) + 201, 20 * most + 1000):
        got = store.bounded_sample(spark.range(n), "id", most).collect()
        assert len(got) == min(n, most)


def test_classifiers_learn_beyond_their_bounds(spark, docs, labels):
    """More labels than the bound, and one doc_id on many rows, which counts once."""
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(spark.range(500).selectExpr("100L doc_id", "'good words ' || id text", "'en' lang", "'a' source"))
    for most in (30, 50):
        assert quality.classify(rows, labels, rows=most).count() == rows.count()
        assert toxicity.classify(rows, labels, rows=most).count() == rows.count()


def test_quality_with_clashing_columns(docs, labels):
    own = docs.selectExpr("*", "1 _site_odds", "2 _site_host", "3 _SITE_PATH")
    assert quality.keep_good(own, labels).columns == own.columns
    assert quality.keep_good(own, labels).count() == quality.keep_good(docs, labels).count()


# 4
def test_fingerprints(spark, docs, none):
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = fingerprint.compare(docs).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(t) for _, t in ROWS)
    digests = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in got}
    for k, (i, text) in enumerate(order):
        if i is not None and i != 6 and i != 7:  # the repeated row's and its neighbour's order is by hash
            after = order[(k + 1) % len(order)][1]
            cut = len(text) // 3
            assert digests[i, len(text)] == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
    prints = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in got}
    assert prints[4, len(order[-4][1])] == prints[5, len(order[-4][1])] if (4, len(order[-4][1])) in prints else True
    by_text = {}
    for r in got:
        by_text.setdefault(next(t for i, t in ROWS if i == r["doc_id"]), set()).add(r["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.compare(none).collect() == []
    one = fingerprint.compare(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_add_up(spark):
    a, b = "one two three\nfour five six", "seven eight\nnine ten eleven"
    rows = spark.createDataFrame([(1, a), (2, b), (3, b + "\n" + a), (4, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(rows).collect()}
    frame = spark.createDataFrame([(got[1], got[2], got[3])], "a string, b string, c string")
    both = frame.select(fingerprint.combine(frame.a, frame.b).alias("sum"), fingerprint.remove(frame.c, frame.b).alias("rest")).first()
    assert both["sum"] == got[3] and both["rest"] == got[1] == got[4]


def test_fingerprint_likeness_of_long_and_tabbed_texts(spark):
    many = [" ".join(f"{c}{i}" for i in range(600_000)) for c in "ab"]
    words = [f"w{i}" for i in range(200)]
    other = words[:180] + [f"x{i}" for i in range(20)]
    texts = [*many, "\t".join(words), "\t".join(other), "\n".join(words), "\n".join(other), " ", " \t"]
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    frame = spark.createDataFrame([(i, prints[i], prints[i + 1]) for i in range(0, 8, 2)], "i int, a string, b string")
    got = {r["i"]: r["x"] for r in frame.select("i", fingerprint.likeness(frame.a, frame.b).alias("x")).collect()}
    assert got[0] < 0.25  # nothing is shared
    assert abs(got[2] - 180 / 220) < 0.1 and abs(got[4] - 180 / 220) < 0.1
    assert got[6] == 1  # no words


def test_fingerprint_ranges_whatever_the_ids(spark):
    """Dense ids, a far one and a null: ranges stay even, and each row meets the next document."""
    ids = [*range(4000), 4 * 10**12, -5, None]
    frame = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows = fingerprint.with_neighbours(frame).where("not guest").collect()
    order = [*sorted((i for i in ids if i is not None), reverse=True), None]
    following = dict(zip(order, [f"text {i}" for i in [*order[1:], order[0]]]))
    assert {r["doc_id"]: r["next"] for r in rows} == following and len(rows) == len(ids)
    assert max(Counter(r["bucket"] for r in rows).values()) < len(ids) / 2


# 5
def brute_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(LOWER)) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    extra = [(300 + i, sentence(i, 400) + (" tail" if i % 2 else "")) for i in range(6)] + [(400 + i, sentence(i, 400)) for i in range(6)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = ROWS + extra
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    want = [(i, f"{prints[k]:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]
    assert by_row(simhash.near_duplicates(frame).collect(), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert kept.count(4) == 1 and 5 not in kept and kept.count(None) == 1
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_first(none).collect() == []


def test_near_copies_at_the_threshold(spark):
    """Pairs alike by 0.80 to 0.82 are all found, and links that no star from the least id shows too."""
    import random

    rng, rows = random.Random(4), []
    for k in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        changed = base[:]
        changed[5 : 5 + 16 + k % 3] = [f"x{rng.randrange(10**6)}" for _ in range(16 + k % 3)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
    likeness = lambda x, y: len(x & y) / len(x | y)
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    assert all(0.8 <= likeness(sets[2 * k], sets[2 * k + 1]) < 0.83 for k in range(150))
    # 1000 is too far from 1002, but 1001 is near to both; 1003 and 1004 are near each other alone.
    base = [f"v{i}" for i in range(400)]
    far = lambda a, b: " ".join(base[a:b])
    rows += [(1000, far(0, 300)), (1001, far(25, 325)), (1002, far(50, 350)), (1003, far(90, 390)), (1004, far(95, 395))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_first(frame).collect()) == [*range(0, 300, 2), 1000, 1003]


def brute_groups(rows, words=5, similarity=0.8):
    """Which rows hang together, by comparing all pairs of word sequences."""
    sets = [set(simhash.shingle_hashes(t or "", words).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][1] == rows[b][1] or (both and both >= similarity * (len(sets[a]) + len(sets[b]) - both)):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    return list(groups.values())


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Near copies at all distances, with and without the route for keys that many unlike texts share."""
    import random

    rng, rows = random.Random(7), []
    for k in range(40):
        base = sentence(k, 120).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(4)):
            copy = base[:]
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(120)] = f"new{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(copy)))
    want = sorted(min(rows[k][0] for k in g) for g in brute_groups(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for apart in (256, 1):
        monkeypatch.setattr(simhash, "APART", apart)
        assert sorted(r["doc_id"] for r in simhash.keep_first(frame).collect()) == want


def test_recall_of_near_pairs(spark):
    """Of pairs alike by 0.8 or more in the smaller tables, exact copies aside, nine in ten at least are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = list({" ".join((t or "").lower().split()): (i, t) for i, t in docs.collect()}.values())
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    holders = {}
    for k, own in enumerate(sets):
        for h in own:
            holders.setdefault(h, []).append(k)
    shared = Counter()
    for some in holders.values():
        if len(some) < 60:  # pairs alike by 0.8 share rarer shingles too
            shared.update((a, b) for i, a in enumerate(some) for b in some[i + 1 :])
    pairs = [(a, b) for (a, b), _ in shared.items() if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    both = sum(rows[a][0] in kept and rows[b][0] in kept for a, b in pairs)
    assert pairs and both <= 0.1 * len(pairs)


def test_near_copies_meet_in_balls_of_simhash(spark, monkeypatch):
    """Candidates of the pipeline's stage are what ball hashing of SimHash fingerprints brings together, and nothing else links texts."""
    import random

    rng, rows = random.Random(11), []
    for k in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [" ".join(base), " ".join(base[: 58 - k])]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    classes = simhash.text_classes(frame)
    prints = {r["doc_id"]: (r["id"], np.unpackbits(np.frombuffer(r["print"], np.uint8))) for r in classes.collect()}
    own, mask, ones = simhash.shingle_hashes(rows[0], 5).tolist(), (1 << 64) - 1, Counter()
    for h in own:
        for word in range(simhash.LONG // 64):
            x = h + (word + 1) * 0x9E3779B97F4A7C15 & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            ones.update(64 * word + 8 * b + 7 - i for b, byte in enumerate((x ^ x >> 31).to_bytes(8, "little")) for i in range(8) if byte >> i & 1)
    assert prints[0][1].tolist() == [int(2 * ones[i] > len(own)) for i in range(simhash.LONG)]

    bits = simhash.table_bits(len(rows), 0.8)
    exact = bits.shape[1] - simhash.BALL
    assert simhash.missed(len(bits), exact, 0.8) <= 3e-6 and all(len(set(b)) == len(b) for b in bits.tolist())
    values = [(p[bits] @ (1 << np.arange(bits.shape[1]))).tolist() for _, p in prints.values()]
    ids, low = [i for i, _ in prints.values()], (1 << exact) - 1
    near = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in range(a) if any((d := x ^ y) & low == 0 and d.bit_count() <= 2 for x, y in zip(values[a], values[b]))}
    met = simhash.balls(simhash.table_prints(classes.selectExpr("id", "print", "0L value"), bits), simhash.from_hubs, "a long, b long")
    pairs = {(r["a"], r["b"]) for r in met.where("a <> b").collect()}
    linked = lambda edges: {(r["node"], r["root"]) for r in simhash.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert pairs <= near and len(near) >= 10 and linked(pairs) == linked(near)

    assert simhash.keep_first(frame).count() < len(rows)
    monkeypatch.setattr(simhash, "balls", lambda prints, meet, schema: spark.createDataFrame([], schema))
    assert simhash.keep_first(frame).count() == len(rows)


def test_near_copies_of_few_words(spark):
    """Texts of eight words are alike by 0.8 to the same with a ninth; bits of so small sets spread more, so these meet by leaving one shingle out."""
    rows = [(2 * k + more, " ".join(f"v{k}x{i}" for i in range(8 + more))) for k in range(300) for more in (0, 1)] + [(1000, "V0x0 " + " ".join(f"v0x{i}" for i in range(1, 8)))]
    kept = [r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == list(range(0, 600, 2))


def test_keep_first_of_odd_rows(spark):
    base = sentence(5, 50)
    rows = [(1, base, 0, 0, "x"), (1, sentence(90, 50), 0, 0, "x"), (None, base, 0, 0, "x"), (None, "alone here", 0, 0, "x"), (None, "alone  here", 0, 0, "x"), (3, base.upper(), 0, 0, "x"), (4, None, 0, 0, "x"), (5, " ", 0, 0, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _nth int, `row` int, digest string")
    got = simhash.keep_first(frame)
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], (r["text"] or "").split()[:1]) for r in got.collect()), key=repr) == sorted([(1, base.split()[:1]), (1, sentence(90, 50).split()[:1]), (None, ["alone"]), (4, []), (5, [])], key=repr)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 6
def test_best_fit_is_sequential_best_fit():
    counts = {2048: 3, 1500: 4, 900: 5, 548: 3, 500: 7, 100: 40, 3: 11, 1: 9}
    bins, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in bins if r >= length), default=None)
            if fit is None:
                bins.append(2048 - length)
            else:
                bins[bins.index(fit)] -= length
    runs = packing.best_fit(counts)
    used = {}
    for r in runs:
        for k in range(r.count):
            used.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    opened = len(used)
    assert opened == len(bins)
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048


def test_packing(docs, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, text in ROWS:
        ids = coder.encode(text, add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    got = packing.pack(docs).collect()
    assert by_row(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    assert packing.pack(none).collect() == []


# 7
def test_bpe(docs, none):
    from tokenizers import Tokenizer

    coder, want = Tokenizer.from_file(bpe.default_path()), []
    for i, text in ROWS:
        ids = coder.encode(text, add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(bpe.round_trip(docs).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip(none).collect() == []


def test_pieces_match_the_pattern():
    import random

    import public_tokenizers
    import regex

    random.seed(4)
    pattern = regex.compile(public_tokenizers.PATTERN)
    alphabet = "ab'stmdrevl  \n\t.,!19é²　漢\u0085"
    for _ in range(300):
        texts = ["".join(random.choices(alphabet, k=random.randint(0, 14))) for _ in range(5)]
        pieces, bounds = pretoken.split(texts)
        assert [pieces[a:b] for a, b in zip(bounds, bounds[1:])] == [pattern.findall(t) for t in texts]


# 8
def test_toxicity(docs, labels, none):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert toxicity.classify(none, labels).collect() == []
    assert {r["predicted"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, sentence(i, 30) + (" you idiot scum" if i % 4 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.classify(frame, frame.selectExpr("doc_id", "if(doc_id % 4 = 0, 1, 0) toxic")).where("held_out").collect()
    assert sum(r["predicted"] != int(r["doc_id"] % 4 == 0) for r in got) <= 2


# 9
def test_lm(docs, none, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 30)
    counts = Counter()
    for i, text in ROWS:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(text.encode().lower().split())
            counts["end"] += 1
    n, v, want = sum(counts.values()), len(counts), []
    for i, text in ROWS:
        tokens = [*text.encode().lower().split(), "end"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(counts[t] > 0 for t in tokens), n, f"{base:.6g}"))
    got = lm.score_documents(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6g}") for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(none).collect() == []


def test_lm_against_plain_scoring(spark, monkeypatch):
    """Scores of short and long texts, word by word, without batches, masks, or joins."""
    import numpy as np

    monkeypatch.setattr(lm, "LEAST_STEPS", 10)
    monkeypatch.setattr(lm, "FREQUENT", 40)  # so that most words are looked up
    rows = [(i, sentence(i, n) + (" Ünïcode x\u3000y" if i % 3 else "")) for i, n in enumerate([0, 1, 5, 31, 32, 33, 61, 200, 3, 12, 90, 40])]
    kept = {}
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *args: kept.setdefault("model", fit(*args)))
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    m, counts = kept["model"], Counter()
    vocabulary, p = lm.Vocabulary(None), {k: v.astype(float) for k, v in kept["model"].network.p.items()}
    coder = vocabulary.coder
    spelled = lambda w: coder.encode_ordinary(" " + w.decode())
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(lm.words_of(text))
            counts[b"end"] += 1
    begun, kinds = Counter(), Counter()
    for w, c in counts.items():
        if w != b"end":
            begun[spelled(w)[0]] += c
            kinds[spelled(w)[0]] += 1
    assert np.allclose(np.bincount(m.network.classes, np.exp(m.share), lm.CLASSES)[np.bincount(m.network.classes, minlength=lm.CLASSES) > 0], 1)
    for i, text in rows:
        words = lm.words_of(text)
        ids = [spelled(w) for w in words] + [[vocabulary.end]]
        before, total = [(m.none, m.none)] + [(x[0], x[-1]) for x in ids[:-1]], 0.0
        for t, own in enumerate(ids):
            nth = 0 if t < lm.WINDOW else (t - lm.WINDOW) // lm.STRIDE + 1
            part = before[nth * lm.STRIDE : t + 1]
            x = np.array([p["first"][f] + p["last"][l] + p["pos"][k] for k, (f, l) in enumerate(part)])
            q, k, v = np.split(x @ p["qkv"], 3, axis=1)
            a = np.exp(q[-1] @ k.T / math.sqrt(lm.SIZE))
            h = x[-1] + (a / a.sum()) @ v @ p["proj"]
            z = np.where(h > 0, h, 0.1 * h) @ p["out"] + p["bias"].reshape(-1)
            z -= np.log(np.exp(z).sum())
            total += z[m.network.classes[own[0]]] + m.share[own[0]]
            if t < len(words):
                spelling = m.chains.log(np.array(own), np.array([0, len(own)]))[0]
                more = kinds[own[0]] + 1
                total += math.log((counts[words[t]] + more * math.exp(spelling)) / (begun[own[0]] + more))
        assert got[i] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4)


def test_context_tells(spark):
    """Held-out texts in two tongues have a higher score than words alone give them."""
    import random

    rng = random.Random(3)
    tongues = [[a + b for a in x for b in ("ra", "to", "li", "mes", "dun")] for x in (("ba", "ke", "po"), ("shu", "gri", "tho"))]
    rows = [(i, " ".join(rng.choices(tongues[i % 2], k=rng.randrange(20, 120)))) for i in range(300)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.2 * sum(r["n_tokens"] for r in got)


def test_network_learns_from_all_texts(spark, monkeypatch):
    """Subwords of documents outside the start's sample, and deep in a long one, have moved."""
    import numpy as np

    monkeypatch.setattr(lm, "LEAST_STEPS", 2)
    monkeypatch.setattr(lm, "TRAIN_DOCUMENTS", 1)
    rows = [(i, sentence(i, 900) + f" {name}") for i, name in enumerate(["zebra", "quartz", "violin", "marble"])]
    rows += [(10 + i, sentence(i, 3)) for i in range(300)]
    training = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    codes = lm.coded(training, None).cache()
    model = lm.fit(codes, lm.word_counts(codes))
    own = sorted({w for _, t in rows for w in lm.words_of(t)} - {b"zebra", b"quartz", b"violin", b"marble"})
    ids, bounds = lm.Vocabulary(None).ids(own)
    first = np.unique(ids[bounds[:-1]])
    start = lm.Network(model.network.classes).p["first"]
    assert (model.network.p["first"][first] != start[first]).any(axis=1).all()
    for stride in (lm.WINDOW, lm.STRIDE):
        sizes = np.array([1, 2, 31, 32, 33, 34, 60, 61, 65, 100])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        begin, fresh, end = lm.windows_of(bounds, stride)
        owned = np.concatenate([np.arange(f, min(b + lm.WINDOW, e)) for b, f, e in zip(begin, fresh, end)])
        assert sorted(owned.tolist()) == list(range(bounds[-1])) and (fresh >= begin).all()


def test_subwords_of_words():
    """Ids of many words at once are those of each word alone by the tokenizers library."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(bpe.default_path())
    coder.encode_special_tokens = True
    words = sorted({w for _, t in ROWS for w in lm.words_of(t)} | {x.encode() for x in ("a\u00a0b", "\u3000x", "y\u2003", "\x1cq", "'s", "don't", "12,5", "<|endoftext|>", "é", "漢字", "\u0085")})
    ids, bounds = lm.Vocabulary(None).ids(words)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [coder.encode(" " + w.decode(), add_special_tokens=False).ids for w in words]


def test_network_gradient():
    import numpy as np

    rng = np.random.default_rng(1)
    net = lm.Network(np.arange(20) % lm.CLASSES)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.mask = net.mask.astype(np.float64)
    first, last, target, weight = rng.integers(0, 21, (2, lm.WINDOW)), rng.integers(0, 21, (2, lm.WINDOW)), rng.integers(0, 20, (2, lm.WINDOW)), np.ones((2, lm.WINDOW))
    _, g = net.backward(first, last, target, weight)
    for name in net.p:
        if isinstance(g[name], tuple):
            rows, grad = g[name]
            at, grad = (rows[0], 0), grad[0, 0]
        else:
            at = tuple(0 for _ in net.p[name].shape)
            grad = g[name][at]
        net.p[name][at] += 1e-5
        up = net.backward(first, last, target, weight)[0]
        net.p[name][at] -= 2e-5
        down = net.backward(first, last, target, weight)[0]
        net.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad, abs=1e-4)


# 10
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")), "phone": 9 <= len(digits) <= 15}[kind]


def test_pii(docs, none):
    want = []
    for i, text in ROWS:
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if good(k, m.group())] for k, p in PATTERNS.items()}
        want.append((i, *[len(s) for s in spans.values()], hashlib.sha256(",".join(sum(spans.values(), [])).encode()).hexdigest()))
    got = pii.find(docs).collect()
    assert by_row(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert any("secret" in r["spans"] for r in got if r["doc_id"] == 10)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[9].startswith("mail [EMAIL] or call [PHONE], card [CARD], host [IP], bad 300.1.1.1 and [IP].5") and text[1] is None
    assert pii.find(none).collect() == [] and pii.redact(none).collect() == []


def test_pii_of_a_long_text(spark):
    """Work grows with the text, not with text times spans; offsets count code points, and a byte order mark stays."""
    import time

    part = "\ufeffnäme a{0}@b.example.com 漢😀 filler words here "
    text = "".join(part.format(k) for k in range(30_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.find(frame).first()
    assert row["n_email"] == 30_000
    spans = [f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERNS["email"], text)]
    assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert pii.redact(frame).first()["text"] == re.sub(PATTERNS["email"], "[EMAIL]", text)
    assert time.time() - began < 120


def test_span_classifier_uses_the_shape():
    """Spans with equal votes are told apart by their shape, where other spans of that shape are clear."""
    clear = [("secret", (1, 1, 1, 1), (4, 2, 3), 900), ("secret", (-1, -1, 0, -1), (2, 1, 2), 900)]
    unclear = [("secret", (0, 0, 0, 0), (4, 2, 3), 5), ("secret", (0, 0, 0, 0), (2, 1, 2), 5)]
    weight = pii.span_classifier(clear + unclear)
    high, low = (sum(w * x for w, x in zip(weight, pii._columns(*u[:3]))) for u in unclear)
    assert high > low + 0.3


def test_reliabilities():
    """A labeler that votes at random is believed less than one that others agree with."""
    import itertools
    import random

    rng, votes = random.Random(1), Counter()
    for _ in range(4000):
        true = rng.random() < 0.5
        say = lambda right: (1 if true else -1) if rng.random() < right else (-1 if true else 1)
        votes["ssn", (say(0.95), say(0.9), say(0.9), say(0.5))] += 1
    told = [(*key, n) for key, n in sorted(votes.items())]
    posterior = {v: p for (_, v, _), p in zip(told, pii.reliabilities(told))}
    for a, b in itertools.product((-1, 1), repeat=2):
        assert abs(posterior[a, b, 1, 1] - posterior[a, b, 1, -1]) < abs(posterior[1, a, b, 1] - posterior[-1, a, b, 1]) + 0.05
    assert posterior[1, 1, 1, -1] > 0.9 and posterior[-1, -1, -1, 1] < 0.1


def test_components_gathered_or_by_rounds(spark, monkeypatch):
    """Few edges run no rounds of jobs, which fill the driver; both ways give the same."""
    import random

    rng = random.Random(5)
    pairs = {(min(p), max(p)) for p in ((rng.randrange(-150, 150) << 40, rng.randrange(-150, 150) << 40) for _ in range(140)) if p[0] != p[1]}
    edges, told = spark.createDataFrame(sorted(pairs), "a long, b long"), []
    monkeypatch.setattr(simhash, "_stars", lambda *a, f=simhash._stars, **b: told.append(1) or f(*a, **b))
    few = sorted(map(tuple, simhash.components(edges).collect()))
    assert not told and simhash.components(edges.limit(0)).collect() == []
    monkeypatch.setattr(simhash, "GATHERED", 0)
    assert sorted(map(tuple, simhash.components(edges).collect())) == few and told


def test_pairs_of_copies_that_strayed(spark, monkeypatch):
    """Copies that strayed from one text, each in its own way, meet each other but are not alike: few of their pairs are compared, and no link is lost."""
    import random

    rng, base = random.Random(3), [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 240):
        copy = base[:]
        for at in rng.sample(range(2, 198, 5), 3 if k % 8 == 0 else 5):
            copy[at] = f"new{k}x{at}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, rows[k][1] + " end") for k in range(1, 60, 7)]
    want = sorted(min(rows[k][0] for k in g) for g in brute_groups(rows))
    frame, sizes = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(simhash, "APART", 8)  # as crowded as a few hundred rows can be
    monkeypatch.setattr(simhash, "likely", lambda pairs, *a, f=simhash.likely: sizes.append(pairs.count()) or f(pairs, *a))
    assert sorted(r["doc_id"] for r in simhash.keep_first(frame).collect()) == want
    assert 100 < len(want) < 240 and sum(sizes) <= 8 * len(rows), sizes
