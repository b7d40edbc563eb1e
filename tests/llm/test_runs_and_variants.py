"""Periodic runs, spelling variants and near-duplicate vectors against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codegauge.llm import vector_dedup as V
from codegauge.llm.periodic_runs import find_runs, least_depth, periodic_runs
from codegauge.llm.spelling_groups import near_words, spelling_groups
from codegauge.llm.vector_dedup import buckets, hadamard, near_vectors
from codegauge.llm.words import U, mix
from tests.llm import helpers as H

# --- runs --------------------------------------------------------------------------------------------------------


def brute_runs(w, length=6, exponent=4):
    out, places = {}, {}
    for i, x in enumerate(w):
        places.setdefault(x, []).append(i)
    apart = {j - i for at in places.values() for i in at for j in at if i < j}
    for q in sorted(q for q in apart if q * exponent <= len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(length, exponent * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(i, text, planted=True):
    w = H.words(text)
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if planted and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def sequence(rng):
    kind = rng.random()
    if kind < 0.5:
        return [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
    if kind < 0.8:
        period = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        return ([rng.randrange(4) for _ in range(5)] + period * rng.randint(1, 7)) * rng.randint(1, 4)
    a, b = [0], [0, 1]
    for _ in range(rng.randint(1, 7)):
        a, b = b, b + a
    return b


@pytest.mark.parametrize("length, exponent", [(6, 4), (4, 3), (9, 5)])
def test_runs_equal_their_definition(length, exponent):
    rng = H.seeded(length)
    for _ in range(150):
        texts = [sequence(rng) for _ in range(rng.randint(1, 6))]
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        hashes = mix(np.array([x for t in texts for x in t], dtype=U) + U(7))
        expected = sorted(([s + int(first[d]), n, q] for d, t in enumerate(texts) for s, n, q in brute_runs(t, length, exponent)),
                          key=lambda r: (r[0], r[2]))
        assert find_runs(hashes, first, length, exponent).tolist() == expected


def test_runs_of_hash_zero_and_of_one_word():
    assert find_runs(np.zeros(50, dtype=U), np.array([0, 20, 50])).tolist() == [[0, 20, 1], [20, 30, 1]]
    assert find_runs(np.zeros(0, dtype=U), np.array([0, 0])).tolist() == []
    assert least_depth(6, 4) == 5


def test_runs_of_awkward_rows(spark):
    rows = [r[:2] for r in H.awkward_rows()] + [(k, "a b " * k + "c") for k in range(40)] + [(100, "x " * 300)]
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for planted in (False, True):
        out = [tuple(r[n] for n in names) for r in periodic_runs(H.docs(spark, rows), planted=planted).collect()]
        assert Counter(out) == Counter(brute_row(i, t, planted) for i, t in rows)
    assert periodic_runs(H.docs(spark, [])).collect() == []
    one = periodic_runs(H.docs(spark, [(1, "z a b a b a b a b y")])).first()
    assert (one["starts"], one["lengths"], one["periods"], one["collapsed_text"]) == ([1], [8], [2], "z a b y")
    with pytest.raises(ValueError):
        periodic_runs(H.docs(spark, []), exponent=2)


# --- spelling ----------------------------------------------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_near(words):
    parts, near = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            parts.setdefault((w[:k] + w[k + 1:], k), set()).add(w)
    for (rest, _), found in parts.items():
        for w in found:
            near[w] |= found - {w}
            if rest in near:
                near[w].add(rest)
                near[rest].add(w)
    return near


def brute_groups(rows, slips):
    count = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if slips and i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 3}
    near = brute_near(words)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def spelled(docs, slips=True):
    return {tuple(r) for r in spelling_groups(docs, slips=slips).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_near_words_of_all_lengths(spark):
    rng = H.seeded(12)
    long = "".join(rng.choice("ab") for _ in range(900))
    words = {"aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "étées", "ètées", "etees", "x" * 47, "x" * 48, "x" * 49, "x" * 50,
             "x" * 20 + "y" + "x" * 28, long, long[:400] + long[401:], long[:500] + "c" + long[501:], long + "z", "z" + long}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(600)}
    out = {(r["word"], r["near"]) for r in near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()}
    assert out == {(w, x) for w, found in brute_near(words).items() for x in found}


def test_spelling_of_awkward_rows(spark):
    rng = H.seeded(13)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(300)] + ["Straße", "straße", "×word×", "ÀÉÎÕÜ", "àéîõü", "strásse"]
    rows = [r[:2] for r in H.awkward_rows()] + [(k, " ".join(rng.choices(words, k=60))) for k in range(60)]
    rows += [(None, " ".join(words)), (7, "hellos hello hello! HELLO-hello hellos_hellos hello")]
    docs = H.docs(spark, rows)
    assert spelled(docs) == brute_groups(rows, True)
    assert spelled(docs, slips=False) == brute_groups(rows, False)
    assert spelled(H.docs(spark, [])) == set() and spelled(H.docs(spark, [(1, None), (2, "a b")])) == set()


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(k, " ".join([w] * 3 * 2**n)) for k, (n, w) in enumerate(enumerate(chain))]
    out = {r[0]: r[2] for r in spelled(H.docs(spark, rows), slips=False)}
    assert out == dict.fromkeys(chain, "bbbbb")


# --- vectors -----------------------------------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.98):
    """(vec_id, n_links, component_id) of rows with distinct ids."""
    n = len(rows)
    ok = [label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, label, v in rows]
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2], dtype=float), np.array(rows[j][2], dtype=float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = set()
    for i in range(n):
        seen, work = {i}, [i]
        while work:
            for j in links[work.pop()] - seen:
                seen.add(j)
                work.append(j)
        head = min(rows[j][0] for j in seen)
        out.add((rows[i][0], len(links[i]), head, head == rows[i][0]))
    return out


def near(rng, v, cosine):
    v = v / np.linalg.norm(v)
    z = rng.normal(size=len(v))
    z -= (z @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def test_hadamard_keeps_lengths():
    rows = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(rows), axis=1), np.linalg.norm(rows, axis=1))
    assert np.allclose(hadamard(hadamard(rows)), rows)


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(2)
    for dim in (20, 64):
        a = rng.normal(size=(2_000, dim))
        b = np.array([near(rng, x, 0.98) for x in a])
        ka, kb = buckets(a, 13), buckets(b, 13)
        meets = ((ka[:, :, :1] == kb) | (kb[:, :, :1] == ka)).any(axis=(1, 2))
        assert meets.all()


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        v = rng.normal(size=32)
        for c in rng.choice([0.975, 0.982, 0.99, 0.9999], size=rng.integers(1, 6)):
            rows.append((int(rng.integers(3)), near(rng, v, c)))
    hub = rng.normal(size=32)
    rows += [(1, near(rng, hub, 0.992)) for _ in range(150)] + [(1, hub)] * 3 + [(2, hub), (None, hub), (None, hub)]
    rows = [(k * 7 % 1009, label, [float(x) for x in np.float32(v)]) for k, (label, v) in enumerate(rows)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, cls string, n int")
    assert {tuple(r) for r in near_vectors(frame).collect()} == brute_vectors(rows)


def test_vectors_awkward(spark):
    inf, nan = float("inf"), float("nan")
    plain = [([1.0, 0.0], 1), ([2.0, 0.0], 1), ([1.0, 0.0], 2), ([1e200, 0.0], 1), ([1e-200, 0.0], 1), ([0.0, 1e-300], 1), ([1.0, 0.0, 0.0], 1), (None, 1), ([], 1),
             ([0.0, 0.0], 1), ([nan, 1.0], 1), ([inf, 1.0], 1), ([None, 1.0], 1), ([1.0, 0.1], 1), ([-1.0, 0.0], 1), ([3.0], 1), ([4.0], 1)]
    rows = [(k, label, v) for k, (v, label) in enumerate(plain)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    scale = lambda v: [x / max(abs(y) for y in v) for x in v] if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else v
    assert {tuple(r) for r in near_vectors(frame).collect()} == brute_vectors([(i, label, scale(v)) for i, label, v in rows])
    assert near_vectors(frame.limit(0)).collect() == []
    again = [(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (None, 1, [1.0, 0.0]), (None, 2, [1.0, 0.0]), (None, None, None)]
    out = near_vectors(spark.createDataFrame(again, "vec_id long, label int, embedding array<double>")).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, [
        (1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, False), (None, 0, None, True), (None, 0, None, True)]))
