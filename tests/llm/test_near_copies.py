"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random

from docloom.llm import near_copies, simhash
from tests.llm import brute


def shingled(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_components(texts, similarity=0.8):
    sets, parent = list(map(shingled, texts)), list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = brute_root(parent, i), brute_root(parent, j)
                parent[max(a, b)] = min(a, b)
    return [brute_root(parent, i) for i in range(len(texts))]


def brute_root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def near_texts():
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    out = ["", None]
    for size in (12, 40, 90, 200):
        for _ in range(8):
            base = [rng.choice(words) for _ in range(size)]
            out.append(" ".join(base))
            for changes in range(1, 5):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(size)] = rng.choice(words)
                out.append(" ".join(copy))
    family = [rng.choice(words) for _ in range(60)]
    out += [" ".join([*family, f"n{k}"]) for k in range(40)] + [" ".join([*family[:20], *(rng.choice(words) for _ in range(40))]) for _ in range(20)]
    rng.shuffle(out)
    return out


def test_near_copies_equal_brute_force(spark):
    texts = near_texts()
    want = set(brute_components(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    # fingerprints within four bits leave most of these copies
    assert simhash.drop_near_duplicates(docs).count() > len(want) + 5
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FEW_LINKS", 0)
    texts = near_texts()[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()} == set(brute_components(texts))


def test_near_copies_without_ids(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(30))
    one, two = text(), text()
    rows = [(None, one), (None, two), (None, one), (None, text()), (5, text()), (5, text()), (7, one + " x"), (9, two + " x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_copies.drop_near_copies(docs).collect())
    assert got == sorted((i or 0, t or "") for i, t in [rows[3], rows[4], rows[5], rows[6], rows[7], rows[8]])


def test_fingerprint_width():
    assert simhash.fingerprint("a b c d e f", 5) != simhash.fingerprint("a b c d e f", 4) == brute.fingerprint("a b c d e f")


def test_nearer_false_links_hide_nothing(spark, monkeypatch):
    """One spanning set at first: in crowds around the similarity its links are mostly false."""
    monkeypatch.setattr(near_copies, "FORESTS", 1)
    rng = random.Random(21)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(900)}" for _ in range(70)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([1, 1, 2])):
                copy[rng.randrange(70)] = f"w{rng.randrange(900)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()} == set(brute_components(texts))


def test_a_crowd_of_near_copies_makes_no_rows_of_pairs(spark, monkeypatch):
    """One large group around the similarity: what is written follows its texts, not their pairs."""
    written, staged = {}, near_copies.staged

    def counted(df, label):
        out = staged(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "staged", counted)
    rng = random.Random(33)
    base, texts = [f"w{rng.randrange(900)}" for _ in range(90)], []
    for _ in range(500):
        copy = list(base)
        for _ in range(rng.choice([1, 3, 4])):
            copy[rng.randrange(90)] = f"w{rng.randrange(900)}"
        texts.append(" ".join(copy))
    want = set(brute_components(texts))
    assert 20 < len(want) < 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()} == want
    assert max(written.values()) <= near_copies.BANDS * len(texts)


def test_blocks_of_a_group_compare_all_pairs():
    rng = random.Random(5)
    sets = [near_copies.np.unique([rng.randrange(-20, 60) for _ in range(rng.randrange(1, 50))]) for _ in range(60)]
    for one in (True, False):
        tree = [rng.random() < 0.5 for _ in sets]
        pairs = [(i, j) for i in range(60) for j in range(60) if i < j and one or not one and tree[i] and not tree[j]]
        want = [(i, j) for i, j in pairs if 2 * len(set(sets[i]) & set(sets[j])) >= len(set(sets[i]) | set(sets[j]))]
        for part in (1, 7, 256):
            got = near_copies.similar_links(sets, tree, one, 0.5, part)
            roots = []
            for links in (want, got):
                forest = near_copies.Forest()
                for i, j in links:
                    forest.join(i, j)
                roots.append([forest.find(i) for i in range(60)])
            assert roots[0] == roots[1] and len(got) < 60
