"""Near duplicates, packing, mixing, sentences and token counts."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.llm import mixing, neardup, packing, sentences, shingles, tokens


def bag(t):
    seen, out = Counter(), set()
    for a, b in zip(t, t[1:], strict=False):
        seen[a + b] += 1
        out.add((a + b, seen[a + b]))
    return out


def edited(rng, t):
    t = list(t)
    for _ in range(rng.randint(1, 3)):
        k = rng.randrange(len(t))
        t[k : k + rng.randint(0, 2)] = [rng.choice("春夏秋冬東西南北上下左右") for _ in range(rng.randint(0, 2))]
    return "".join(t)


def near_rows(n=150, seed=3):
    rng = random.Random(seed)
    letters = [chr(0x4E00 + i) for i in range(300)]
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 60))) for _ in range(n)]
    texts = base + [edited(rng, rng.choice(base)) for _ in range(2 * n)]
    texts += rng.choices(texts, k=n) + [None, "", "短い", texts[0] + "後" * 3000]
    return list(enumerate(texts))


def brute(rows, threshold=0.8, least=24):
    own = [(i, t, bag(t)) for i, t in rows if t and len(t) >= least]
    out = set()
    for x, (i, a, A) in enumerate(own):
        for j, b, B in own[x + 1 :]:
            if a != b and 2 * len(A & B) >= threshold * (len(A) + len(B)) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def test_near_duplicates(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "id long, text string")
    got = [tuple(r) for r in neardup.similar_records(df).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want)
    assert neardup.similar_records(df.where("false")).count() == 0


def test_large_buckets_lose_nothing(spark):
    rng = random.Random(8)
    root = "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(60))
    rows = [(i, root[: i % 59] + chr(0x6000 + i) + root[i % 59 + 1 :]) for i in range(90)]
    texts = neardup.distinct_texts(spark.createDataFrame(rows, "id long, text string"), 24)
    pick = lambda block: {(r.a, r.b) for r in neardup.similar_texts(texts, block=block).collect()}
    small, whole, want = pick(8), pick(1000), brute(rows)
    assert small == whole <= want and len(whole) >= 0.99 * len(want)  # though their wording is in every text


def test_family_of_a_third_of_all_texts(spark):
    rng = random.Random(5)
    root, rows = [chr(0x4E00 + rng.randrange(300)) for _ in range(60)], []
    for i in range(360):
        text = list(root) if i % 3 == 0 else [chr(0x4E00 + rng.randrange(3000)) for _ in range(60)]
        for p in rng.sample(range(60), 3) if i % 3 == 0 else ():
            text[p] = chr(0x6000 + rng.randrange(8000))
        rows.append((i, "".join(text)))
    texts = neardup.distinct_texts(spark.createDataFrame(rows, "id long, text string"), 24)
    got, want = {(r.a, r.b) for r in neardup.similar_texts(texts).collect()}, brute(rows)
    assert got <= want and len(want) > 1000 and len(got) >= 0.97 * len(want)  # their own wording is common, their edits are rare


def test_classes(spark):
    rows = near_rows(60, 5)
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.class_id for r in neardup.groups(df).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {tuple(r) for r in neardup.similar_records(df).collect()}
    same = defaultdict(list)
    for i, t in rows:
        if t and len(t) >= 24:
            same[t].append(i)
    for i, j in [*pairs, *((m[0], x) for m in same.values() for x in m)]:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i, _ in rows}


def test_circulant_signatures_estimate_jaccard():
    rng = random.Random(1)
    a = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(400))
    b = a[:300] + "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(100))
    h, o = shingles.bigram_elements([a, b])
    s = shingles.signatures(h, o, 512)
    A, B = bag(a), bag(b)
    assert abs((s[0] == s[1]).mean() - len(A & B) / len(A | B)) < 0.08
    assert shingles.shared_counts([a], [b])[0] == len(A & B)


def best_fit_bins(sizes, capacity):
    """Number of bins by best fit decreasing."""
    rests = []
    for size in sorted(map(int, sizes), reverse=True):
        k = min((r, i) for i, r in enumerate(rests) if r >= size)[1] if any(r >= size for r in rests) else len(rests)
        if k == len(rests):
            rests.append(capacity)
        rests[k] -= size
    return len(rests)


def test_packing(spark):
    rng = np.random.default_rng(2)
    for capacity in (10, 100, 512):
        sizes = rng.integers(0, capacity + 1, 700)
        bins = packing.pack(sizes, capacity)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= capacity and len(fill) <= best_fit_bins(sizes, capacity) and len(fill) <= 1.05 * np.ceil(sizes.sum() / capacity) + 1
    tight = np.array([6, 6, 6, 4, 4, 4] * 20 + [5] * 40)
    assert len(np.unique(packing.pack(tight, 10))) == 80


def test_search_empties_a_bin():
    sizes, bins = np.array([6, 3, 5, 4, 1, 1]), np.array([0, 0, 1, 1, 2, 2])
    out = packing.improve(sizes, bins, 10)
    assert len(np.unique(out)) == 2 and np.bincount(out, weights=sizes).max() <= 10


def test_search_decides(spark):
    """The search starts from a packing with a tenth more containers, and ends where no step gains."""
    rng = np.random.default_rng(4)
    for capacity, top in ((512, 400), (2048, 900), (64, 40)):
        sizes = rng.integers(0, top, 3000)
        start = packing.next_fit(sizes, capacity)
        out = packing.improve(sizes, start, capacity)
        fill = np.bincount(out, weights=sizes)
        least = -(-sizes.sum() // capacity)
        assert fill.max() <= capacity and least <= (fill > 0).sum() <= best_fit_bins(sizes, capacity) < 0.95 * (start.max() + 1)
        assert (packing.improve(sizes, out, capacity) == out).all()
    tiny = packing.pack(np.ones(20_000, int), 8192)
    assert np.bincount(tiny).tolist() == [8192, 8192, 3616] or len(np.unique(tiny)) == 3
    assert packing.pack(np.zeros(5, int), 8).tolist() == [0] * 5 and packing.pack(np.array([5, 0, 5, 0, 3]), 8).max() == 1


DOCS = "doc_id long, text string, source string, size string"


def docs(spark, n=300):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta(x)", "日本語", "\n\n", "x = 1;"]) for _ in range(rng.randint(0, 60))), rng.choice("aaabc"), "s") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "a", "s"), (n + 1, "", "b", "s"), (n + 2, "word " * 5000, "c", "s"), (n + 3, "x y", None, "s")], DOCS)


def reference_counter(name):
    import tiktoken

    path = f"{tokens.folder()}/{tokens.FILES[name]}"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_equal_the_tokenizer(spark):
    rng = random.Random(3)
    pool = ["word", " ", "\n", "\t", "'s", "12", "É", "日本", "<|endoftext|>", "...", " ", "　", "x_y", "²", "\r\n", "\x1c"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: (r.a, r.b) for r in tokens.counted(df, ["i"], "t", {"a": tokens.FILES["gpt2"], "b": tokens.FILES["o200k_base"]}).collect()}
    a, b = reference_counter("gpt2"), reference_counter("o200k_base")
    assert all(got[i] == (len(a.encode_ordinary(t)), len(b.encode_ordinary(t))) for i, t in enumerate(texts))


def test_containers(spark):
    specs = [packing.Spec(1, 64, "gpt2"), packing.Spec(2, 512, "o200k_base")]
    df = docs(spark)
    out = packing.assign(df, specs, cell_items=100)
    sizes = {s.spec_id: len for s in specs}
    counts = {r.doc_id: {1: r.n0, 2: r.n1} for r in tokens.counted(df, ["doc_id"], "text", {"n0": tokens.FILES["gpt2"], "n1": tokens.FILES["o200k_base"]}).collect()}
    rows = out.collect()
    for s in specs:
        own = [r for r in rows if r.spec_id == s.spec_id]
        per, fill = defaultdict(int), defaultdict(int)
        for r in own:
            per[r.doc_id] += r.piece_tokens
            fill[r.container] += r.piece_tokens
        assert dict(per) == {d: n[s.spec_id] for d, n in counts.items()} and max(fill.values()) <= s.capacity
        assert all(len([r for r in own if r.doc_id == d]) == max(1, -(-n[s.spec_id] // s.capacity)) for d, n in counts.items())
    assert {r.spec_id: r.fill > 0.95 for r in packing.fills(out, specs).collect()} == dict.fromkeys(sizes, True)
    assert packing.assign(df.where("false"), specs).count() == 0


def test_shares_are_met(spark):
    """Shares within a thousandth, caps kept, and the same selection where lengths are cut into parts."""
    rng = np.random.default_rng(5)
    rows = [(i, s, int(max(1, rng.lognormal(5, 1.2)))) for i, s in enumerate(rng.choice(["a", "b", "c", "d"], 9000, p=[0.7, 0.2, 0.06, 0.04]).tolist())]
    rows += [(20_000 + i, "a", 40) for i in range(4000)]  # one length of a third of all documents
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long").repartition(4).persist()
    targets = {"a": mixing.Target(0.3, 1), "b": mixing.Target(0.3, 2), "c": mixing.Target(0.25, 4), "d": mixing.Target(0.15, 3)}
    for piece in (50_000, 100):
        mixing.PIECE, kept = piece, mixing.PIECE
        try:
            chosen = mixing.select(counts, targets).collect()
        finally:
            mixing.PIECE = kept
        got = defaultdict(int)
        for r in chosen:
            got[r.source] += r.tokens * r.copies
            assert 1 <= r.copies <= targets[r.source].repeats
        total = sum(got.values())
        assert all(abs(got[s] / total - t.share) < 0.001 for s, t in targets.items()) and len({r.doc_id for r in chosen}) == len(chosen)
    with pytest.raises(RuntimeError):
        mixing.solve(np.array([1, 2]), np.array([5, 5]), 3.0, 1.0, 0.5, 1.0, steps=1)
    assert mixing.solve(np.array([1, 2]), np.array([5, 5]), 15.0, 1.0, 0.5, 1.0) == float("inf")


def test_mixing(spark):
    targets = {"a": mixing.Target(0.5, 1), "b": mixing.Target(0.3, 3), "c": mixing.Target(0.2, 2), "none": mixing.Target(0.5, 2)}
    counts = mixing.token_table(docs(spark, 3000))
    chosen = mixing.select(counts, targets)
    rows = chosen.collect()
    assert all(1 <= r.copies <= targets[r.source].repeats and r.tokens > 0 for r in rows)
    got = {r.source: (r.actual_share, r.most_copies) for r in mixing.shares(chosen, targets).collect()}
    assert abs(got["a"][0] - 0.5) < 0.02 and abs(got["b"][0] - 0.3) < 0.02 and abs(got["c"][0] - 0.2) < 0.02 and got["none"] == (0.0, 0)
    assert mixing.select(counts.where("false"), targets).count() == 0
    assert mixing.select(counts, {"zz": mixing.Target(1.0, 1)}).count() == 0
    small = mixing.select(counts, targets, total=2000.0).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert 1500 < small < 2600


CASES = [
    ("en", "Dr. Smith met J. Doe at 5 p.m. on Monday.| It cost 3.5 dollars, e.g. a lot.| Why \"v1.2\"?| Yes!", None),
    ("en", 'The log says "Stop. Do not merge." for now.| "Ready?" asks he.| (All done.)| It (off!) stays.| So... is it?', None),
    ("en", "Acme Works, Inc. owns it.| We saw maps, etc. |See fig. 3.", "|"),
    ("de", "Am 19. Mai kam u. a. Dr. Kest, z. B. um 5.| „Halt. Noch nicht.“ stand da.| Nr. 4 bleibt offen...| Siehe S. 3 bzw. Abb. 2.", None),
    ("fr", "Voir p. 4, p. ex. la table.| « Prêt ? » demande M. Petit.| C'est fini !", None),
    ("es", "El Sr. Paz llegó a las 9.10 h.| ¿Y qué pasa con el n.º 3?| Véase la pág. 2.", None),
    ("ru", "См. стр. 4, т. е. всё.| Есть карты и т. д.| «Готов ли он?» спрашивает бот.", None),
    ("ja", "設定はx.cfgに書く。|えっ！？|「待て。まだ。」とログに出る。|（省略できる。）|本当に……大丈夫か。", None),
    ("zh", "他说：“等等！还没好。”|目录里有图（图2。）的说明。|“好了吗？”脚本每晚都会问。|不在！", None),
    ("ko", "정말... 괜찮을까?| 로그에는 \"멈춰. 아직.\"라고 나온다.| (생략.)| 끝.", None),
    ("ar", "لماذا؟!| قاس د. سامي زمن 5.5 ثانية.| يقول «قف. لا تدمج.» كل ليلة.", None),
    ("hi", "डॉ. राम ने 5 मि.से. मापा।| क्यों?!| नहीं!", None),
]


@pytest.mark.parametrize("lang, marked, _", CASES)
def test_boundaries(lang, marked, _):
    text = marked.replace("|", "")
    ends, at = [], 0
    for part in marked.split("|"):
        at += len(part)
        ends.append(len(text[:at].rstrip()))
    assert [b for _, b in sentences.sentences(text, lang)] == ends


def test_blocks():
    text = "# Head\nOne line\ngoes on. Two.\n\n- item one\n* item. Two\n```\nno. sentence.\n```\nlast\n\nend"
    got = [text[a:b] for a, b in sentences.sentences(text, "en")]
    assert got == ["# Head", "One line\ngoes on.", "Two.", "item one", "item.", "Two", "last", "end"]


def test_unmarked_blocks():
    text = "# a comment. Two\n```\nkept. too\n\n* x. Y"
    assert [text[a:b] for a, b in sentences.sentences(text, "en", marked=False)] == ["# a comment.", "Two\n```\nkept.", "too", "* x.", "Y"]


def test_rules_see_all_that_stands_before():
    """Quotations behind many spaces, and long runs before a position."""
    text = "He left." + " " * 40 + "“Stop now.” " + "He said" + " " * 30 + "“Go.” and left. x" + "." * 60 + " and on."
    got = [text[a:b] for _, b in [(0, 0)] for a, b in sentences.sentences(text, "en")]
    assert got == ["He left.", "“Stop now.”", "He said" + " " * 30 + "“Go.” and left.", "x" + "." * 60 + " and on."]


@pytest.mark.parametrize("rare", [False, True])
def test_recall_inside_a_family(rare):
    """A third of all texts are edits of one: pairs that share a band, by similarity."""
    rng = random.Random(5)
    letters = [chr(0x4E00 + k) for k in range(1500)]
    root, texts = [rng.choice(letters) for _ in range(60)], set()
    for i in range(1050):
        own = list(root) if i < 350 else [rng.choice(letters) for _ in range(rng.randint(30, 80))]
        for _ in range(rng.randint(1, 5) if i < 350 else 0):
            k = rng.randrange(len(own))
            new = [chr(0x6000 + rng.randrange(8000)) if rare else rng.choice(letters) for _ in range(rng.randint(0, 3))]
            own[k : k + rng.randint(0, 3)] = new
        texts.add("".join(own))
    texts = sorted(t for t in texts if len(t) >= 24)
    h, o = shingles.bigram_elements(texts)
    frequency = np.bincount(shingles.element_slots(h), minlength=1 << shingles.UNIVERSE_BITS)
    weights = np.log((len(texts) + 1) / (frequency + 0.5)) ** 2
    weights = np.maximum(weights, weights.max() / neardup.RATIO).astype(np.float32)
    keys = [shingles.band_keys(shingles.signatures(h, o, b * r, w), b, r) for b, r, w in ((neardup.BANDS, neardup.ROWS, weights), (neardup.PLAIN_BANDS, neardup.PLAIN_ROWS, None))]
    keys = np.concatenate((keys[0], ~keys[1]), axis=1)
    sets = [set(h[o[i] : o[i + 1]].tolist()) for i in range(len(texts))]
    found, near = [], []
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            dice = 2 * len(sets[i] & sets[j]) / (len(sets[i]) + len(sets[j]))
            if dice >= 0.8:
                met = bool((keys[i] == keys[j]).any())
                found.append(met)
                near += [met] if dice < 0.85 else []
    assert len(near) > 500 and np.mean(found) >= 0.985 and np.mean(near) >= 0.97


def test_unfinished_classes_are_refused(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "u long, v long")
    assert {r.class_id for r in neardup.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        neardup.components(chain, rounds=1)


def test_documents(spark):
    long = "One two three. " * 20_000
    rows = [(1, "Ä. Ö!", None, 0), (1, "Ä. Ö!", None, 0), (2, None, "en", 0), (3, "", None, 0), (4, "```\nx", None, 0), (5, long, "en", 0), (6, "文。\U0001f600字。", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prose_lang string, sent_end int")
    out = sentences.split_documents(df)
    per = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert per == {1: 2 * len(sentences.sentences("Ä. Ö!", None)), 5: 20_000, 6: 2}
    assert [r.sent_end for r in out.where("doc_id = 6").orderBy("sent_no").collect()] == [2, 5]
    assert out.where("false").count() == 0
