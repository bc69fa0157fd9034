"""Learned operators against plain versions: automaton, convolution, gradients, trust on a linked graph, weighted Pareto order."""

import random

import numpy as np

from taleweave.llm import language, mixing, toxicity, urls


def edits(a, b):
    """The distance by insertions, deletions, substitutions and swaps of neighbours."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_match_against_edit_distance():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcd", k=n))
    terms, stems = sorted({word(rng.randint(3, 9)) for _ in range(12)}), sorted({word(rng.randint(4, 7)) for _ in range(5)})
    lex = toxicity.Lexicon(terms, stems)
    for _ in range(3000):
        w = list(rng.choice(terms + stems)) + list(word(rng.choice((0, 0, 2))))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choices("abcd", k=rng.randint(0, 1))
        w = "".join(w)
        exact = w in terms or any(w.startswith(s) for s in stems)
        near = len(w) >= toxicity.FUZZY_FROM - 1 and (any(len(t) >= toxicity.FUZZY_FROM and edits(w, t) <= 1 for t in terms) or any(len(s) >= toxicity.FUZZY_FROM and min(edits(w[:k], s) for k in range(len(w) + 1)) <= 1 for s in stems))
        got = lex.match(w)
        assert (got is not None) == (exact or near) and (got is None or (got[1] == 1.0) == exact), w


def test_scores_against_a_plain_loop():
    model = {"terms": ["idiot", "scum"], "stems": ["lowei"], "known": [], "weights": np.array([2.0, 1.0, 0.5, -3.0])}
    lex = toxicity.Lexicon(model["terms"], model["stems"], model["known"])
    texts = ["you scum", "", None, "fine day", 'he said "scum" then', "idoit loweing scum scum", "a " * 50 + "scum" + " a" * 50 + " idiot"]
    got = toxicity.score_texts(model, lex, texts)
    for t, s in zip(texts, got, strict=True):
        words = (t or "").lower().replace('"', "").split()
        at = [i for i, w in enumerate(words) if lex.match(w)]
        weights = [lex.match(words[i])[1] * (toxicity.QUOTED if t and '"' in t else 1) * (1 + toxicity.NEIGHBOUR * min(3, sum(abs(j - i) <= toxicity.SPAN for j in at) - 1)) for i in at]
        x = [np.log1p(sum(weights)), max(weights, default=0), np.log1p(len({lex.match(words[i])[0] for i in at}))]
        assert abs(s - 1 / (1 + np.exp(-(np.dot(model["weights"][:3], x) + model["weights"][3])))) < 1e-9


def small_network():
    rng = np.random.default_rng(2)
    p = {"emb": rng.normal(0, 0.5, (257, language.DIM)), "out": rng.normal(0, 0.3, (len(language.WIDTHS) * language.FILTERS, 3)), "bias": rng.normal(0, 0.1, 3)}
    for w in language.WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 0.3, (w * language.DIM, language.FILTERS)), rng.normal(0, 0.1, language.FILTERS)
    return p


def plain(p, window):
    """Filter by filter, place by place."""
    pooled = []
    for w in language.WIDTHS:
        best = np.full(language.FILTERS, 0.0)
        for i in range(language.WINDOW - w + 1):
            best = np.maximum(best, np.concatenate([p["emb"][b] for b in window[i : i + w]]) @ p[f"w{w}"] + p[f"b{w}"])
        pooled.append(best)
    z = np.exp(np.concatenate(pooled) @ p["out"] + p["bias"])
    return z / z.sum()


def test_prediction_against_plain_convolution():
    p = small_network()
    m = {"names": ["a", "b", "c"], **p}
    texts = ["short", "é" * 200, "word " * 60]
    names, scores = language.predict(m, language._tables(m), texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        x, _, sizes = language.windows([t])
        q = sum(plain(p, row) * n for row, n in zip(x, sizes, strict=True)) / sizes.sum()
        assert m["names"][int(q.argmax())] == name and abs(q.max() - score) < 1e-4


def test_gradients():
    p = small_network()
    x, _, _ = language.windows(["abc abd", "xyz" * 20, "hello world " * 5])
    y, weight = np.arange(len(x)) % 3, np.ones(3)
    loss = lambda: -np.mean([np.log(plain(p, row)[k]) for row, k in zip(x, y, strict=True)])
    grads = language._gradients(p, x, y, weight)
    rng = np.random.default_rng(3)
    for name in ("out", "bias", "w2", "b3", "w4"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-5
        up = loss()
        p[name][at] = old - 1e-5
        down = loss()
        p[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4, name


def test_letters():
    assert not any(map(language._letter, ["½", "² Ⅷ", "123 _", "", "①"])) and all(map(language._letter, ["½a", "ж", "漢", "é1"]))


def test_trust_against_a_dense_solver(spark):
    rng = random.Random(6)
    n, d = 25, urls.DAMPING
    links = {(a, b): rng.randint(1, 4) for a in range(n) for b in rng.sample(range(n), 3) if a != b and a != 7}
    allowed, blocked = np.zeros(n), np.zeros(n)
    allowed[:5], blocked[20:] = 0.7, 0.4
    m = np.zeros((n, n))
    for (a, b), k in links.items():
        m[a, b] = k
    forth = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
    back = np.divide(m.T, m.T.sum(1, keepdims=True), out=np.zeros_like(m), where=m.T.sum(1, keepdims=True) > 0)
    want = [np.linalg.solve(np.eye(n) - d * x.T, (1 - d) * s) for x, s in ((forth, allowed), (back, blocked))]
    shares = spark.createDataFrame([(f"h{i}", float(allowed[i]), float(blocked[i])) for i in range(n)], "host string, allowed double, blocked double")
    frame = spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in links.items()], "src string, dst string, links long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(shares, frame).collect()}
    assert all(abs(got[f"h{i}"][k] - want[k][i]) < 1e-8 for i in range(n) for k in (0, 1))


def test_weighted_pareto_order(spark):
    """Unequal odds within a source: the sample is the head of the order by random odds over inclusion odds, up to the words."""
    import hashlib

    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(3, 30)), f"s{i % 3}", rng.choice((0.3, 1.0, 2.0))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, own double")
    got = {r["doc_id"]: r for r in mixing.mix(frame, weight="own").collect()}
    for s in ("s0", "s1", "s2"):
        mine = [(i, len(t.split()), w) for i, t, c, w in rows if c == s]
        target = got[mine[0][0]]["target"]
        size = sum(n for _, n, _ in mine)
        mean = sum(w * n for _, n, w in mine) / size
        order, words = [], 0
        for i, n, w in mine:
            expected = min(3.0, target / size * w / mean)
            whole, p = int(expected), expected - int(expected)
            words += whole * n
            assert got[i]["copies"] in (whole, whole + 1) or p == 0
            u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if p > 0:
                order.append((u / (1 - u) * (1 - p) / p, i, n, whole))
        taken = {}
        for _, i, n, whole in sorted(order):
            if words + n > target:
                break
            words, taken[i] = words + n, whole + 1
        extra = [i for _, i, _, whole in order if got[i]["copies"] > whole]
        assert taken.keys() <= set(extra) and len(set(extra) - taken.keys()) <= 1
