"""Near-duplicates, repeated passages, embeddings and mixing against plain versions."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, embeddings, hnsw, minhash, mixing, substrings, words


def unions(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def copies(r, n, size=60):
    """Texts of which some are near copies in chains, some exact ones."""
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.5 or not out:
            out.append([f"w{r.randrange(3000)}" for _ in range(r.randrange(1, size))])
        else:
            w = list(r.choice(out))
            for _ in range(r.randrange(3) if kind < 0.9 else 0):
                w[r.randrange(len(w))] = f"w{r.randrange(3000)}"
            out.append(w)
    return [" ".join(w) for w in out]


def plain_near(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], unions(len(sets), links)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs_of, size):
    texts = [None, "", " ", "One", "one", "A b", "É", "é", *copies(random.Random(size), 250)]
    n, roots = plain_near(texts, size, 80)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(texts), size).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(got[i]["kept"] == (roots[i] == i) for i in range(len(texts)))


def test_a_large_group_of_near_copies(docs_of):
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(700):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(80)] = f"x{r.randrange(10_000)}"
        texts.append(" ".join(w))
    _, roots = plain_near(texts, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(texts), 2).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def plain_roots(texts, percent=80):
    """The components of many near copies by products of incidence matrices."""
    sets = [set(zip(w, w[1:])) for w in map(str.split, texts)]
    places = {}
    for g in sets:
        for x in g:
            places.setdefault(x, len(places))
    m = np.zeros((len(sets), len(places)), np.float32)
    for i, g in enumerate(sets):
        m[i, [places[x] for x in g]] = 1
    n, links = m.sum(axis=1), []
    for at in range(0, len(m), 500):
        both = m[at : at + 500] @ m.T
        links += [(a + at, b) for a, b in zip(*np.nonzero(100 * both >= percent * (n[at : at + 500, None] + n - both)), strict=True) if a + at > b]
    return unions(len(sets), links)


@pytest.mark.parametrize(("n", "part"), [(4000, minhash.BY_SKETCH), (1500, 100)])
def test_many_near_copies_of_one_text(docs_of, n, part, monkeypatch):
    """A hub whose rows are partly too far from it and from each other, also when it is dealt to many cells."""
    monkeypatch.setattr(minhash, "BY_SKETCH", part)
    monkeypatch.setattr(minhash, "BY_SET", part // 4)
    r, texts = random.Random(6), []
    for _ in range(n):
        w = [f"w{i}" for i in range(70)]
        for _ in range(r.randrange(9)):
            w[r.randrange(70)] = f"x{r.randrange(30)}"
        texts.append(" ".join(w))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(texts), 2).collect()}
    assert [got[i] for i in range(n)] == plain_roots(texts)


def test_cells_take_little_memory():
    """The largest cell, with every row in a component of its own."""
    r, n = np.random.default_rng(1), 2 * minhash.BY_SKETCH
    t = pa.table({
        "b": np.arange(n), "n": np.full(n, 100), "root": np.arange(n), "lo": np.full(n, 0.1), "hi": np.full(n, 0.3), "p": np.arange(n) % 2, "i": np.zeros(n, int), "j": np.ones(n, int),
        "sketch": pa.array([x.tobytes() for x in r.integers(0, 255, (n, 32), dtype=np.uint8)], pa.binary()),
    })
    tracemalloc.start()
    assert not minhash.open_rows(t, 80).any()
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_sketches_differ_by_places():
    r = np.random.default_rng(2)
    four = r.integers(0, 3, (6, 64), dtype=np.uint8)
    packed = (four[:, ::2] | four[:, 1::2] << 4).copy().view(np.uint64)
    assert (minhash.differences(packed[:4], packed[2:]) == (four[:4, None] != four[None, 2:]).sum(axis=2)).all()


def test_near_duplicates_of_nothing(docs_of, spark):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    twice = docs_of(["a b c", None]).union(docs_of(["a b c", None]))
    assert minhash.near_duplicates(twice).count() == 4
    no_id = twice.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert minhash.near_duplicates(no_id).where("component_id IS NULL").count() == 4
    assert minhash.stage(spark, no_id, "").count() == 4
    kept = minhash.stage(spark, twice, "")
    assert kept.columns == twice.columns and kept.count() == 2


def test_word_hashes():
    h = words.word_hashes("a  bb\ta\x0bcc bb".encode())
    assert len(h) == 5 and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert len(words.word_hashes(b"")) == len(words.word_hashes(b" \n")) == 0
    assert len(words.word_hashes(b"x" * 50_000)) == 1


def test_components_of_paths_and_stars(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    want = unions(300, links)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: want[n] for n in range(300) if want[n] != n}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_passages(texts):
    seen, out = set(), []
    for t in texts:
        w, gone = re.findall(r"[^ \t-\r]+", t or ""), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(r, n):
    shared = [[f"p{i}_{j}" for j in range(r.randrange(18, 60))] for i in range(5)]
    texts = [None, "", "a " * 200, "x"]
    for _ in range(n):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += r.choice(shared)[r.randrange(4) :] if r.random() < 0.5 else [f"w{r.randrange(200)}" for _ in range(r.randrange(1, 50))]
        texts.append(" ".join(w))
    return [*texts, *texts[5:8]]


def test_stretches_of_texts_together_are_those_of_each_alone():
    """Texts are hashed in groups: no window, stretch or hash may hang on the text's neighbours."""
    r = random.Random(5)
    texts = [None, "", " ", "a " * 19, "b " * 20, "b " * 20, "é ü\xa0x " * 40] + [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(200))) for _ in range(60)]
    assert [n for i, j in substrings._grouped(texts) for n in range(i, j)] == list(range(len(texts))) and list(substrings._grouped([])) == []
    h, heads = substrings._hashes(texts)
    hashes = [words.word_hashes((t or "").encode()) for t in texts]
    assert np.array_equal(h, np.concatenate(hashes)) and np.diff(heads).tolist() == list(map(len, hashes))
    for hot in (np.zeros(0, np.uint64), np.unique(substrings.anchors(h, heads, np.zeros(0, np.uint64))[0])[::3]):
        want = []
        for doc, own in enumerate(hashes):
            for row in zip(*substrings.anchors(own, np.array([0, len(own)]), hot), strict=True):
                want.append((row[0], row[1], doc, row[3], row[4]))
        assert list(zip(*substrings.anchors(h, heads, hot), strict=True)) == want and len(want) > 100
        assert all(sum(x[4] for x in want if x[2] == d) == max(0, len(own) - 19) for d, own in enumerate(hashes))


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_repeated_passages(docs_of, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = passages(random.Random(4), 80)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.cleaned(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_passages(texts)


def test_passages_of_nothing(docs_of):
    assert substrings.cleaned(docs_of([])).count() == 0
    twice = docs_of(["a b " * 30]).union(docs_of(["a b " * 30]))
    assert substrings.cleaned(twice).count() == 2


@pytest.mark.parametrize("text", [np.random.default_rng(0).integers(1, 5, 400), np.tile([1, 2, 3], 130), np.ones(65, int)], ids=["mixed", "periodic", "one"])
def test_index_finds_all_occurrences(text):
    text, n = np.append(text, 0), len(text)
    index = substrings.FmIndex(text)
    assert sorted(index.locate(np.arange(n + 1))) == list(range(n + 1)) and len(index.places) <= n // substrings.SAMPLE + 1
    for size in (2, 5, 9):
        starts = np.arange(0, n - size)
        length, lo, hi = index.matching(text, starts, size)
        for s in starts[::7]:
            # The longest suffix of the window that occurs more than once, and where it does.
            want, places = 0, []
            for k in range(1, size + 1):
                part = text[s + size - k : s + size]
                found = [i for i in range(n - k + 1) if (part == text[i : i + k]).all()]
                if len(found) > 1:
                    want, places = k, found
            assert length[s] == want and sorted(index.locate(np.arange(lo[s], hi[s]))) == places


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, embedding array<float>, node string")


def test_embeddings(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 16)).astype(np.float32)
    for i in range(60, 300):
        x[i] = x[i % 60] + r.normal(size=16) * 0.1 * (i % 5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15), (405, [1.0, 2.0]), (406, rows[3][1]), (407, [2 * v for v in rows[3][1]])]
    good = {i: np.array(v, float) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = list(good)
    unit = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    close = unit @ unit.T >= 0.95
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close), strict=True) if a < b]
    roots = unions(408, links)
    n = {i: int(close[k].sum()) - 1 for k, i in enumerate(ids)}
    got = {q["vec_id"]: q for q in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert [got[i]["n_links"] for i in range(408)] == [n.get(i, 0) for i in range(408)]
    assert [got[i]["component_id"] for i in range(408)] == roots
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_graph_recall():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x)
    q = x[:200] + r.normal(size=(200, 24)).astype(np.float32) * 0.05
    ids, _ = g.search(q, 64)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) > 0.9


def test_audit_widens_until_recall(monkeypatch):
    monkeypatch.setattr(embeddings, "BEAM", 1)
    r = np.random.default_rng(3)
    x = r.normal(size=(1, 8)) + 0.05 * r.normal(size=(500, 8))
    exact = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(exact.astype(np.float32))
    a, _, recall = embeddings.linked(g, exact, exact, exact.astype(np.float32))
    assert recall >= embeddings.RECALL and len(a) == (exact @ exact.T >= 0.95).sum()


def test_graphs_in_parts_lose_no_links():
    """Tight groups between which the graph may have no way: found by comparing with all, and in short time."""
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(4, 16)), 1500, axis=0) + 0.01 * r.normal(size=(6000, 16))
    exact = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(exact.astype(np.float32))
    q = exact[::20]
    began = time.perf_counter()
    a, b, recall = embeddings.linked(g, exact, q, q.astype(np.float32), own=np.arange(0, 6000, 20))
    assert recall == 1.0 and len(a) == (q @ exact.T >= 0.95).sum() and time.perf_counter() - began < 20


def test_a_match_with_itself_is_no_link_found():
    x = np.eye(40)
    x[1] = x[0]
    g = hnsw.Graph.build(x.astype(np.float32))
    g.layers[0][:] = -1  # nothing can be found
    a, b, recall = embeddings.linked(g, x, x, x.astype(np.float32), own=np.arange(40))
    assert recall == 1.0 and {(0, 1), (1, 0)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_mixing_keeps_to_its_targets(docs_of):
    source = ["a"] * 500 + ["b"] * 300 + ["c"] * 200 + [None] * 40
    rows = mixing.mix(docs_of(["t"] * len(source), source=source), {"a": 5, "b": 3, "c": 2}, block_rows=4).collect()
    assert len(rows) == len(source)
    blocks = sorted({(r["_slot"], r["source"]) for r in rows})
    assert len({s for s, _ in blocks}) == len(blocks)
    target, seen = {"a": 5 / 11, "b": 3 / 11, "c": 2 / 11, None: 1 / 11}, dict.fromkeys(["a", "b", "c", None], 0)
    last = min(max(s for s, x in blocks if x == k) for k in seen)
    for s, x in blocks:
        if s > last:
            break
        seen[x] += 1
        assert all(abs(seen[k] - target[k] * (s + 1)) < 1 for k in seen), (s, seen)


def plain_slots(parts):
    """Earliest deadline first, slot by slot: (source, k) by slot for one cycle."""
    q, at, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    order = sorted(parts, key=lambda s: (s is None, s or ""))
    for t in range(q):
        free = [(-(-(at[s] + 1) * q // parts[s]), i) for i, s in enumerate(order) if at[s] * q < (t + 1) * parts[s]]
        s = order[min(free)[1]]
        out.append((s, at[s]))
        at[s] += 1
    return out


@pytest.mark.parametrize("parts", [{"a": 5, "b": 3, "c": 2, None: 1}, {"a": 6, "b": 4, "c": 4, "d": 4, "e": 2, None: 4}, {f"s{i}": 1 + i * 7 % 23 for i in range(60)}])
def test_cycle_is_earliest_deadline_first(spark, parts):
    got = {r["source"]: r for r in mixing.cycle(spark.createDataFrame(list(parts.items()), "source string, n bigint")).collect()}
    q = sum(parts.values())
    slots = {}
    for s, r in got.items():
        assert parts[s] % r["n"] == 0 and q % r["q"] == 0 and q // r["q"] == parts[s] // r["n"]
        for turn in range(q // r["q"]):
            slots |= {turn * r["q"] + t: (s, turn * r["n"] + k) for k, t in enumerate(r["slots"])}
    assert [slots[t] for t in range(q)] == plain_slots(parts)


def test_a_thousand_sources(docs_of):
    rows = mixing.mix(docs_of(["t"] * 6000, source=[f"s{i % 1200}" for i in range(6000)]), block_rows=1).collect()
    assert sorted(r["_slot"] for r in rows) == list(range(6000))
    assert all(r["_slot"] // 1200 == r["_block"] for r in rows)


def test_mixing_keeps_columns_with_its_own_names(docs_of):
    names = ["k", "q", "t", "n", "s", "id", "h", "r", "row", "at", "start", "block", "slots", "s_", "r_", "pos", "_k", "_range", "_parts", "_c", "a.b"]
    docs = docs_of(["x", "y", None] * 5, source=["a", "b", None] * 5)
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(700 + i))
    out = mixing.mix(docs.withColumn("_block", F.lit(7)).withColumn("_slot", F.lit(8)))
    assert out.columns == [*docs.columns, "_block", "_slot"]
    rows = out.drop("_block", "_slot").collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, docs.collect())) and all(r["_n"] == 1 for r in rows)
    assert {r["_slot"] for r in out.collect()} == {0, 1, 2}
    assert sorted(map(repr, mixing.stage(None, docs, "").collect())) == sorted(map(repr, docs.collect()))


def test_mixing_uneven_ids(docs_of, monkeypatch):
    """Ids at both ends of the range, crowded ids and null ones: numbered as a sort by id would."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    docs = docs_of([str(i) for i in range(400)])
    id_ = F.when(F.col("doc_id") == 0, F.lit(-(1 << 63))).when(F.col("doc_id") == 1, F.lit((1 << 63) - 1)).when(F.col("doc_id") % 4 != 2, F.col("doc_id"))
    rows = mixing.mix(docs.withColumn("doc_id", id_), block_rows=1).collect()
    assert sorted(r["_slot"] for r in rows) == list(range(400))
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["_slot"])]
    assert ids[:100] == [None] * 100 and ids[100:] == sorted(ids[100:])


def test_mixing_odd_tables(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    docs = docs_of(["t", None, ""], source=[None, "", "x"])
    twice = docs.union(docs).withColumn("doc_id", (docs["doc_id"] % 2))
    assert mixing.mix(twice).count() == 6 and mixing.stage(None, twice, "").columns == twice.columns
    assert mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("bigint"))).count() == 3
