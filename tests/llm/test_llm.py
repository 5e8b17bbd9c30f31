"""The training-data operators against brute force, round trips, held-out accuracy, and awkward rows."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import ann, chat, common, language, line_dedup, mixing, pieces, quality, queries, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and another " * 60_000


def docs(spark, rows):
    return spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else r for r in rows], DOCS)


def awkward(spark):
    """Nulls in any column, empty and very long texts, repeats, and columns whose names clash with working ones."""
    rows = [(1, "alpha beta gamma delta", "en", "a"), (1, "alpha beta gamma delta", "en", "a"), (2, None, None, None), (3, "", "de", ""), (None, "x y z", None, "b"), (4, LONG, "fr", "a"), (5, " \n\t ", None, "c"), (6, "alpha beta gamma delta", None, "c")]
    return docs(spark, rows).withColumns({"score": F.lit(1), "h": F.lit("x"), "size": F.lit(None).cast("int"), "fp": F.lit(2), "taken": F.lit(3)})


#: Every working name that an operator puts beside the columns of documents, or could.
WORKING = ("gl_id", "gl_th", "gl_key", "gl_parts", "gl_gone", "gl_times", "gl_pass", "gl_score", "gl_text", "gl_lines", "gl_removed", "gl_score_", "row", "id", "times", "key", "parts", "gone", "gone_id", "gone_th", "col", "a`b")


@pytest.mark.parametrize("op", ["lines", "mixed", "keep_first", "reject"])
def test_columns_pass_through_whatever_their_names(spark, op):
    rows = [(1, "alpha beta gamma delta", "en", "a"), (2, "alpha beta gamma delta", "en", "b"), (3, "own words\nalpha beta gamma delta", None, "c"), (4, None, None, None), (5, "", "", "")]
    d = docs(spark, rows).withColumns({n: F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")) for n in WORKING})
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    run = {"lines": lambda x: line_dedup.dedup_lines(x, 3), "mixed": mixing.mixed, "keep_first": simhash.keep_first, "reject": lambda x: toxicity.reject(x, labels)}[op]
    out = run(d)
    assert out.columns[: len(d.columns)] == d.columns and len(out.columns) == len(d.columns) + 2 * (op == "lines")
    got = [r[: len(d.columns)] for r in out.collect()]
    assert {r[0] for r in got} >= ({1, 2, 3, 4, 5} if op in ("lines", "reject") else {1, 3}) and all(r[5:] == tuple(f"{n}:{r[0]}" for n in WORKING) for r in got)
    plain = run(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, plain)) == sorted(map(str, out.select("doc_id", "text").collect()))
    assert run(d.limit(0)).count() == 0


# ---- line dedup ---------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    sites, first = defaultdict(set), {}
    for d, text, _, s in rows:
        for p, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                sites[line].add(s)
                first[line] = min(first.get(line, (d, p)), (d, p))
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if len(sites.get(x, ())) < least or first[x] == (d, p)) for d, t, _, s in rows}


@pytest.mark.parametrize("least", [2, 3, 7])
def test_line_dedup(spark, least):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["", "one", "two two", "only %d" % i, "three", " ", "four"]) for _ in range(rng.randint(1, 6))), None, f"s{rng.randint(0, 8)}") for i in range(80)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), least).collect()}
    assert got == brute_lines(rows, least)


def test_line_dedup_awkward(spark):
    d = awkward(spark)
    out = line_dedup.dedup_lines(d, 2)
    assert out.columns == [*d.columns, "gl_lines", "gl_removed"]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got[(1, "alpha beta gamma delta")] == 2 and got[(6, "")] == 1 and got[(2, None)] == 1 and got[(3, "")] == 1
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# ---- language -------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(2)
    syl = {"aa": ["the", "ing", "wh"], "bb": ["sch", "ung", "ei"], "cc": ["ción", "os", "ll"]}
    rows = [(i, " ".join("".join(rng.choices(syl[k], k=3)) for _ in range(20)), k, None) for i, k in enumerate(rng.choices(list(syl), k=400))]
    out = language.identify_held_out(docs(spark, rows)).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 50 and all(r["lang_pred"] == rows[r["doc_id"]][2] and 0 <= r["score"] <= 1 for r in held)


def test_language_awkward(spark):
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_held_out(awkward(spark)).collect()}
    assert got[2] == got[3] == got[5] == "und" and got[4] in ("en", "fr", "de")
    assert language.identify_held_out(docs(spark, [])).count() == 0


def test_a_text_of_numerals_has_no_language():
    model = language.LanguageModel(["a", "b"], language.codewords(2), np.zeros((language.BUCKETS, 1), np.float32), np.ones(1), np.ones(1), np.ones(1))
    assert [model.predict(t)[0] for t in (None, "", "12 _", "½ ²", "Ⅷ ½", "½ x", "é")] == ["und"] * 5 + ["a"] * 2


def test_codewords_differ():
    for n in (2, 4, 7, 12):
        c = language.codewords(n)
        assert len({tuple(r) for r in c}) == n


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_mixing_targets():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        sizes, w = [rng.choice([0, rng.randint(0, 1000)]) for _ in range(n)], [(5, 2, 1)[i % 3] for i in range(n)]
        t, free, left = [0.0] * n, set(range(n)), float(sum(sizes))
        while free:
            share = left / sum(w[i] for i in free)
            over = {i for i in free if w[i] * share > 3 * sizes[i]}
            if not over:
                for i in free:
                    t[i] = w[i] * share
                break
            for i in over:
                t[i] = 3.0 * sizes[i]
                left -= t[i]
            free -= over
        assert np.allclose(mixing.targets(sizes, w), t)


def test_route_is_a_flow_of_least_cost():
    flow = mixing.route([10, 10, 5], [[0], [0, 1], [1]], [12, 20])
    assert sum(flow[0]) + flow[1][0] == 12 and flow[1][1] + flow[2][0] == 20
    loads = [sum(f) / c for f, c in zip(flow, [10, 10, 5], strict=True)]
    assert max(loads) <= 2


def test_route_against_a_plain_flow():
    """Least cost by augmenting word by word along the cheapest path, found by Bellman and Ford."""
    rng = random.Random(29)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 4)
        cap, own, quota = [rng.randint(0, 4) for _ in range(n)], [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(n)], [rng.randint(0, 9) for _ in range(m)]
        arcs = []
        for p in range(n):
            arcs += [[0, 2 + p, cap[p], k] for k in (1, 2, 3)] + [[2 + p, 2 + n + s, 99, 0] for s in own[p]]
        arcs += [[2 + n + s, 1, quota[s], 0] for s in range(m)]
        arcs += [[b, a, 0, -w] for a, b, _, w in arcs]
        half, words, price = len(arcs) // 2, 0, 0
        while True:
            far, via = {0: 0}, {}
            for _ in range(n + m + 2):
                for i, (a, b, r, w) in enumerate(arcs):
                    if r and a in far and far[a] + w < far.get(b, 10**9):
                        far[b], via[b] = far[a] + w, i
            if 1 not in far:
                break
            x, words, price = 1, words + 1, price + far[1]
            while x:
                i = via[x]
                arcs[i][2] -= 1
                arcs[(i + half) % (2 * half)][2] += 1
                x = arcs[i][0]
        flow = mixing.route(cap, own, quota)
        loads = [sum(f) for f in flow]
        assert sum(loads) == words and all(x <= 3 * c for x, c in zip(loads, cap, strict=True))
        assert all(sum(f[o.index(s)] for f, o in zip(flow, own, strict=True) if s in o) <= quota[s] for s in range(m))
        assert price == sum(min(c, max(0, x - k * c)) * (k + 1) for x, c in zip(loads, cap, strict=True) for k in range(3))


def test_route_of_many_sources_is_quick():
    n = 30_000
    began = time.time()
    flow = mixing.route([5] * n, [[i] for i in range(n)], [i % 20 for i in range(n)])
    assert [f[0] for f in flow] == [min(15, i % 20) for i in range(n)] and time.time() - began < 30


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(400)]
    out = mixing.mix_sources(docs(spark, rows)).collect()
    again = mixing.mix_sources(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == 400
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len((rows[r["doc_id"]][1]).split()) and r["taken"] <= 3 * r["size"]
        by[rows[r["doc_id"]][3]].append(r)
    for rs in by.values():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 40


def test_mixing_overlap_and_awkward(spark):
    over = spark.createDataFrame([(i, "a b c d", ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else ["y"]) for i in range(90)], "doc_id long, text string, source array<string>")
    out = mixing.mix_sources(over).collect()
    assert abs(sum(r["taken"] for r in out) - 360) <= 8
    d = awkward(spark)
    got = mixing.mix_sources(d).collect()
    assert len(got) == 8 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mixed(d).columns == d.columns


def test_mixing_of_many_sources(spark, monkeypatch):
    rng = random.Random(26)
    rows = [(i, " ".join(["w"] * (rng.randint(0, 40) if n else 0)), None, f"s{n}" if n < 60 else [None, "", "big"][n - 60]) for i, n in enumerate([*range(63), *(min(62, int(rng.expovariate(0.03))) for _ in range(900))])]
    want = sorted(map(tuple, mixing.mix_sources(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    assert sorted(map(tuple, mixing.mix_sources(docs(spark, rows)).collect())) == want
    assert len({r[3] / r[2] for r in want if r[2]} - {3.0}) > 1 and any(r[3] == 3 * r[2] > 0 for r in want)
    alone = docs(spark, rows).withColumn("source", F.array("source"))
    assert [r[:3] + r[4:] for r in sorted(map(tuple, mixing.mix_sources(alone).collect()))] == [r[:3] + r[4:] for r in want]
    with pytest.raises(ValueError):
        mixing.mix_sources(alone.withColumn("source", F.when(F.col("doc_id") < 9, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("source"))))


# ---- quality, toxicity ----------------------------------------------------------------------------------------------


def labelled(spark, bad, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.3
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
        rows.append((i, bad(words, rng) if y else " ".join(words), None, None))
        labels.append((i, int(not y), int(y)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


def test_quality(spark):
    d, lab, want = labelled(spark, lambda w, g: " ".join(x + "$$" for x in w))
    got = [r for r in quality.score_held_out(d, lab).collect() if r["held_out"]]
    assert len(got) > 80 and np.mean([r["predicted"] == want[r["doc_id"]][1] for r in got]) > 0.97


def test_toxicity(spark):
    d, lab, want = labelled(spark, lambda w, g: " ".join([*w, g.choice(["lout", "oaf"])]))
    got = [r for r in toxicity.score_held_out(d, lab).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == want[r["doc_id"]][2] for r in got]) > 0.97
    kept = toxicity.reject(d, lab)
    assert kept.columns == d.columns and kept.count() < d.count()


def test_counterfactual_penalty_evens_identity_terms():
    rng = random.Random(7)
    rows = [((["muslim"] if rng.random() < 0.9 else []) + ["oaf"], 1) for _ in range(60)] + [(["christian"] if rng.random() < 0.5 else ["tree"], 0) for _ in range(60)]
    pairs = [(["muslim"], ["christian"])] * 20
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(toxicity.fit(rows, pairs)) < 0.25 * gap(toxicity.fit(rows, []))
    assert ("christian", "people") in toxicity.swaps("Muslim people")


@pytest.mark.parametrize("op,col", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_awkward(spark, op, col):
    lab = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (99, 1)], f"doc_id long, {col} int")
    out = op.score_held_out(awkward(spark), lab).collect()
    assert len(out) == 8 and all(0 <= r["score"] <= 1 for r in out)
    empty = spark.createDataFrame([], f"doc_id long, {col} int")
    assert op.score_held_out(docs(spark, []), empty).count() == 0
    assert op.score_held_out(awkward(spark), empty).count() == 8


# ---- SimHash ----------------------------------------------------------------------------------------------------------


def brute_print(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, bits=2):
    root = {d: d for d in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in prints}


def test_simhash_against_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices("ab CD ef gh IJ kl Mn op".split(), k=rng.randint(0, 60))) for _ in range(25)]
    rows = []
    for i in range(200):
        w = rng.choice(base).split()
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w), None, None))
    prints = {d: brute_print(t, 3) for d, t, *_ in rows}
    want = brute_components(prints)
    for r in simhash.near_duplicates(docs(spark, rows), 3).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("cap,bits", [(256, 2), (1, 2), (256, 6), (4, 6)])
def test_links_hold_components(spark, monkeypatch, cap, bits):
    monkeypatch.setattr(simhash, "BUCKET", cap)
    monkeypatch.setattr(simhash, "WIDE_BUCKET", cap)
    rng = random.Random(9)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 15)):
            fps.add(x)
            for _ in range(rng.randint(1, bits + 1)):
                x ^= 1 << rng.randrange(64)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    found = common.connected_components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = brute_components({s: f for s, f in signed.items()}, bits)
    group = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert group({s: got.get(s, s) for s in signed}) == group(want)


@pytest.mark.parametrize("bits", [2, 6])
def test_masks_cover_all_pairs(bits):
    pairs = simhash.bands(bits)
    rng = random.Random(10)
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits)))
        assert any(not diff & a and not diff & b for a, b in pairs)


def test_long_texts_come_in_pieces(monkeypatch):
    text = " ".join(random.Random(11).choices(["aé", "b", "cc"], k=3000))
    want = simhash.fingerprint(text, 5)
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprint(text, 5) == want == brute_print(text, 5)


@pytest.mark.parametrize("group", [512, 6])
def test_similar_texts_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120, 300])) for _ in range(14)] + [[]]
    rows = []
    for i in range(260):
        w = list(base[0] if rng.random() < 0.3 else rng.choice(base))
        for _ in range(rng.randint(0, 4 + len(w) // 30) if w else 0):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w), None, None))
    sets, prints = {}, {}
    for i, t, *_ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        prints[i] = brute_print(t, 5)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), similarity=0.8).collect()}
    assert got == {i: top(i) for i in sets} and 20 < len(set(got.values())) < 250


def test_copies_with_repeated_lines_are_linked(spark):
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, apart = [], 0
    for n in range(12):
        own, line = rng.choices(vocabulary, k=300), rng.choices(vocabulary, k=6)
        a, b = " ".join(own), " ".join(own + line * 60)
        rows += [(2 * n, a, None, None), (2 * n + 1, b, None, None)]
        apart += (brute_print(a, 5) ^ brute_print(b, 5)).bit_count() > 26
    assert apart > 0
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), similarity=0.8).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_texts_of_equal_keys_are_told_apart(spark):
    rng = random.Random(24)
    vocabulary = [f"w{i}" for i in range(5000)]
    upper, sets = None, None
    while upper is None or sets is None:
        own = rng.choices(vocabulary, k=300)
        fp, keys, found = simhash.sketch(" ".join(own), 5)
        for _ in range(40):
            w = [*own[:-1], rng.choice(vocabulary)] if rng.random() < 0.5 else [*own, *rng.choices(vocabulary, k=rng.randint(1, 6))]
            fp2, keys2, found2 = simhash.sketch(" ".join(w), 5)
            if (keys == keys2).all() and not np.array_equal(found, found2):
                if fp == fp2:
                    sets = " ".join(own), " ".join(w)
                elif (fp ^ fp2) & 0xFFFFFFFF == 0 and (fp ^ fp2).bit_count() > 2:
                    upper = " ".join(own), " ".join(w)
    rows = [(i, t, None, None) for i, t in enumerate([*upper, *sets])]
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), similarity=0.8).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    store = simhash.sketches(docs(spark, rows).coalesce(1), 5).collect()
    assert len({r["cid"] for r in store}) == 4 and all(r["shingles"] for r in store)


def test_slices_discard_no_similar_pair():
    rng = np.random.default_rng(23)
    for n in (1, 2, 9, 300, 5000):
        base = np.unique(rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32))
        sets = [base, *(np.unique(np.concatenate([rng.permutation(base)[: max(1, round(len(base) * k))], rng.integers(-(1 << 31), 1 << 31, round(n * (1 - k))).astype(np.int32)])) for k in (0.5, 0.85, 0.88, 0.9, 0.92, 1.0))]
        table = simhash.slice_counts(sets)
        assert (table.sum(axis=1) == [len(s) for s in sets]).all()
        for i, a in enumerate(sets):
            for k, b in enumerate(sets):
                assert len(np.intersect1d(a, b)) <= np.minimum(table[i], table[k]).sum()
                pair = simhash.group_links(np.array([1, 2], np.uint64), [a, b], 0.8)
                assert bool(pair) == (len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)))


def test_simhash_awkward(spark):
    d = awkward(spark)
    out = simhash.near_duplicates(d).collect()
    assert len(out) == 8 and {r["component_id"] for r in out if r["doc_id"] in (1, 6)} == {1} and {r["component_id"] for r in out if r["doc_id"] in (2, 3, 5)} == {2}
    kept = simhash.keep_first(d)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "None"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# ---- chat ---------------------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>x<|says|>y<|done|>\n", "<\\/s> <\\\\/s>", "[\\INST]", "", None, "a <<SYS>> b <</SYS>>", "<", "[", "plain\n\ntext <|done|>", "🙂 é"]
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "<|says|>"]), rng.choice(hard)) for c in range(40) for t in range(rng.randint(1, 6))]
    made = chat.examples(spark.createDataFrame(rows, CHAT)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1], r[2] or "", r[3] or ""))
    turns = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in chat.examples(spark.createDataFrame(rows, CHAT)).where("whole").select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert turns == {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    said = spark.createDataFrame(made).select("conv_id", "example", chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("t"), "formatted", "loss_start", "loss_length")
    got = defaultdict(list)
    for r in said.orderBy("conv_id", "example").collect():
        if r["loss_start"] is not None:
            got[r["conv_id"]].append(r["t"])
            assert r["formatted"][r["loss_start"] + r["loss_length"] :] == "<|done|>\n"
    assert all(got[c] == [x[2] for x in sorted(v) if x[1] == "assistant"] for c, v in by.items())


def test_chat_awkward(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 1, "assistant", "x" * 100_000)]
    d = spark.createDataFrame(rows, CHAT).withColumns({"t": F.lit(1), "example": F.lit(2)})
    out = {r["conv_id"]: r for r in chat.digests(chat.examples(d)).collect()}
    assert out[1]["n_turns"] == 2 and out[1]["loss_chars"] == 0 and out[2]["loss_chars"] == 100_000 and out[None]["n_turns"] == 1
    assert chat.digests(chat.examples(spark.createDataFrame([], CHAT))).count() == 0


def test_chat_stays_native(spark):
    plan = queries.op6_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


# ---- SentencePiece ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    with open(queries.PIECE_MODEL, "rb") as f:
        return f.read()


def test_pieces_equal_the_library(model):
    enc, sp, rng = pieces.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(13)
    letters = "ab the ing er  \n\t▁é世界🙂ﬁ0x<>s</|.,! ABCdefgh"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "   a", "a" * 500, " " * 50 + "x", "<0x41></s><unk>"]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        want = sp.encode(t)
        assert got.tolist() == want and enc.decode(got.tolist()) == sp.decode(want)


def test_pieces_with_small_memory(model, monkeypatch):
    want = pieces.Encoder(model)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 40)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 25)
    enc, rng = pieces.Encoder(model), random.Random(27)
    for _ in range(60):
        texts = [" ".join("".join(rng.choices("etaoin", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        for a, b, t in zip(enc.encode(texts), want.encode(texts), texts, strict=True):
            assert a.tolist() == b.tolist() == want.processor.encode(t)


def test_shared_prefixes():
    rng = random.Random(28)
    words = sorted({"".join(rng.choices("ab\0é", k=rng.choice([0, 1, 2, 5, 30, 60]))) for _ in range(900)} | {"a" * n for n in range(50)})
    same = pieces.shared_prefixes(words)
    assert same == [0, *(next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:], strict=False))]
    assert pieces.shared_prefixes([]) == []


def test_unigram_viterbi(model):
    enc = pieces.Encoder(model)
    enc.kind = 1
    enc.ids = {" ": 0, "a": 1, "b": 2, "ab": 3, "ba": 4, " a": 5, "abab": 6}
    enc.score = {" ": -2.0, "a": -1.5, "b": -1.4, "ab": -2.0, "ba": -2.5, " a": -2.2, "abab": -4.5}
    enc.build()

    def best(w):
        return max(((enc.score[w[:k]] + best(w[k:])) for k in range(1, len(w) + 1) if w[:k] in enc.score), default=0.0) if w else 0.0

    back = {v: k for k, v in enc.ids.items()}
    words = [" " + "".join(random.Random(i).choices("ab", k=i % 9)) for i in range(60)]
    for w, ids in enc.encode_words(set(words)).items():
        cut = [back[i] for i in np.frombuffer(ids, np.int32).tolist()]
        assert "".join(cut) == w and np.isclose(sum(enc.score[c] for c in cut), best(w))


def test_pieces_awkward(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    d = awkward(spark)
    for r in pieces.encode(d, queries.PIECE_MODEL, ("doc_id", "text")).collect():
        assert r["ids"] == (None if r["text"] is None else sp.encode(r["text"]))
    assert pieces.encode(docs(spark, []), queries.PIECE_MODEL).count() == 0
    ids = pieces.encode(d, queries.PIECE_MODEL, ("doc_id", "text", "score")).withColumnRenamed("text", "was")
    back = pieces.decode(ids, queries.PIECE_MODEL, keep=("doc_id", "was")).collect()
    assert len(back) == 8 and all(r["text"] == r["was"] for r in back) and pieces.decode(ids.limit(0), queries.PIECE_MODEL).count() == 0
    assert all(r["same"] for r in pieces.encode_digest(d, queries.PIECE_MODEL).where("n_ids is not null").collect())


# ---- searches ------------------------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=1500, d=16, clusters=60):
    rng = np.random.default_rng(14)
    mid = rng.normal(size=(clusters, d))
    x = (mid[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)
    x[: n // 3] = x[0]
    return x, spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], VEC)


def test_nearest_recall_and_scores(spark):
    x, df = vectors(spark)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    y, hits, n = x.astype(float), 0, 0
    assert set(got) == set(range(0, 1500, 10))
    for q, rs in got.items():
        rs.sort()
        dist = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        assert [r[0] for r in rs] == list(range(1, 11)) and all(r[1] == dist[r[2]] and r[2] != q for r in rs)
        assert [(r[1], r[2]) for r in rs] == sorted((r[1], r[2]) for r in rs)
        dist[q] = np.inf
        hits, n = hits + sum(r[1] <= np.sort(dist)[9] for r in rs), n + 10
    assert hits / n >= 0.9


def test_nearest_of_each_length(spark):
    rng = np.random.default_rng(25)
    x = {i: rng.normal(size=3 if i % 3 else 5).astype(np.float32) for i in range(27)} | {200: np.ones(2, np.float32)}
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist(), None) for i, v in x.items()], VEC), F.col("vec_id") % 2 == 0, k=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 6)))
    for q in range(0, 27, 2):
        far = {i: float(np.sqrt(((v.astype(float) - x[q]) ** 2).sum())) for i, v in x.items() if len(v) == len(x[q]) and i != q}
        assert sorted(got[q]) == [(n + 1, i, round(far[i], 6)) for n, i in enumerate(sorted(far, key=lambda i: (far[i], i))[:4])]
    assert set(got) == set(range(0, 27, 2))


def test_nearest_with_repeated_ids_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 4)
    monkeypatch.setattr(ann, "WIDE_BLOCK", 16)
    monkeypatch.setattr(ann, "SPAN", 48)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 60)
    rng = np.random.default_rng(30)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[100:300] = x[100]
    ids = np.where(np.arange(700) % 5 == 0, 40, np.arange(700))
    got = defaultdict(list)
    df = spark.createDataFrame([(int(i), v.tolist(), None) for i, v in zip(ids, x, strict=True)], VEC)
    for r in ann.nearest(df, F.col("vec_id") % 7 == 0, recall=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = n = 0
    for q in {int(i) for i in ids if i % 7 == 0 and i != 40}:
        far = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(axis=1))
        least: dict[int, float] = {}
        for i, f in zip(ids.tolist(), far.tolist(), strict=True):
            if i != q:
                least[i] = min(f, least.get(i, np.inf))
        rs = sorted(got[q])
        assert [r[0] for r in rs] == list(range(1, 11)) and len({r[1] for r in rs}) == 10 and [r[1:] for r in rs] == sorted((r[1:] for r in rs), key=lambda r: (r[1], r[0]))
        assert all(r[2] >= least[r[1]] for r in rs)
        hits, n = hits + sum(r[2] <= sorted(least.values())[9] for r in rs), n + 10
    assert hits / n >= 0.9


def test_hilbert_neighbours_touch():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    walk = cells[np.argsort(ann.hilbert_key(cells, 3))]
    assert len(set(ann.hilbert_key(cells, 3).tolist())) == 512 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("spread", [1.0, 1e3, 1e6])
def test_top_products_exact(spark, spread):
    x, _ = vectors(spark, 900)
    x = x * np.float32(spread)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], VEC).repartition(5)
    q = np.floor(256 * x.astype(float)).astype(np.int64).astype(object)
    got = defaultdict(list)
    for r in topk.top_products(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 900, 50):
        s = q @ q[i]
        want = sorted((k for k in range(900) if k != i), key=lambda k: (-s[k], k))[:5]
        assert sorted(got[i]) == [(n + 1, k, s[k]) for n, k in enumerate(want)]


def test_top_products_over_many_shards(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("LEAF", 8), ("PACK", 7), ("ROOTS", 3), ("PROBES", 1), ("PROBE_LEAVES", 1), ("CHUNK", 3)):
        monkeypatch.setattr(topk, name, value)
    x, df = vectors(spark, 600, d=5)
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    got = defaultdict(list)
    for r in topk.top_products(df.repartition(4), F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 600, 20):
        s = q @ q[i]
        want = sorted((k for k in range(600) if k != i), key=lambda k: (-s[k], k))[:5]
        assert sorted(got[i]) == [(n + 1, k, s[k]) for n, k in enumerate(want)]


@pytest.mark.parametrize("op,zero", [(ann.nearest, False), (topk.top_products, True)])
def test_searches_awkward(spark, op, zero):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 1.0], 1), (4, [None, 1.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, 2.0], 1), (None, [1.0, 1.0], 1), (7, [], 1), (100, [1.0, 2.5], 1)]
    df = spark.createDataFrame(rows, VEC).withColumns({"v": F.lit(1), "query": F.lit(2), "raw": F.lit("x")})
    got = [(r["query_id"], r["vec_id"]) for r in op(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    own = {0: {6, 100}, 100: {0, 6}}
    if zero:
        own = {k: v | {5} for k, v in own.items()}
    assert {q: {v for k, v in got if k == q} for q, _ in got} == own and len(got) == sum(map(len, own.values()))
    assert op(spark.createDataFrame([], VEC), F.col("vec_id") % 100 == 0).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_awkward(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward(spark), str(tmp_path))
        empty = stage(spark, awkward(spark).limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns, name
        got = out.collect()
        if name != "sentencepiece":
            assert out.columns == awkward(spark).columns, name
        ids = Counter(str(r["doc_id"]) for r in got)
        want = {"simhash_near_dedup": {"1", "2", "4", "None"}, "mixing": {"1", "4", "6", "None"}}.get(name, {"1", "2", "3", "4", "5", "6", "None"})
        assert set(ids) <= want and (name == "mixing" or set(ids) == want), name


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialise(stage(spark, docs_, d))
        assert out.columns == docs_.columns, name
        docs_ = out
    last = corpus_pipeline.run(spark, d)
    assert isinstance(last.schema["ids"].dataType, T.ArrayType) and last.count() == docs_.count() > 0
