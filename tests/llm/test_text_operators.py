"""Training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import pickle
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, decontam, linededup, neardup, pseudonyms, quality, rotation, tokencount, toxicity

DATA = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string, lang string"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    """A few hundred real documents with odd rows: null, empty, white space, ties, a long one, a repeated row, null ids."""
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, "One"), (9006, "one two"), (9007, "x " * 30_000), (9008, "same words here again today"), (9008, "same words here again today"), (None, "no id at all here today"), (None, None), (9010, "𝄞 ẞ\x00 é́")]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})
    return own.unionByName(more).withColumn("n_words", F.lit(1)).withColumn("id", F.lit(2)).cache()


def items(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- encoding ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tables():
    return bpe.load_tables(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_as_the_library(docs, tables):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made = bpe.encode_column(docs, tables, raw=True).collect()
    expected = collections.Counter()
    for i, t in items(docs):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made) == expected


def test_bpe_odd_strings(tables):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    enc = bpe.Encoder(tables)
    rng = random.Random(5)
    pool = ["a", "b", "É", "ß", "Σ", "İ", "1", "½", "'s", "'LL", "<|endoftext|>", "<|", "\n", "\x1c", "\x85", "中", "🤗", "é", "_", "...", "the", "ing", " ", "ﬁ", "​"]
    for _ in range(5000):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == tk.encode(s, add_special_tokens=False).ids, repr(s)
    for _ in range(3000):
        s = "".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(enc.word(s), "<u4").tolist() == tk.encode(s, add_special_tokens=False).ids, s


def test_bpe_empty_table_and_clash(spark, tables):
    assert bpe.encode_column(spark.createDataFrame([], EMPTY), tables).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_column(spark.createDataFrame([], EMPTY + ", n_tokens int"), tables, keep=("doc_id", "n_tokens"))


def test_token_counts_add_up(docs):
    ranks = tokencount.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sets = {}
    for rule in tokencount.RULES:
        sets[rule] = tokencount.token_counts(docs, ranks, public_tokenizers.PATTERN, ("source", "text"), rule=rule).collect()
        assert all(sum(s.n_tokens for s in r.sections) == r.n_tokens for r in sets[rule])
    texts = collections.defaultdict(list)
    for r in docs.select("doc_id", "source", "text").collect():
        texts[r.doc_id].append((r.source or "") + "\n" + (r.text or ""))
    for r in sets["first"]:
        whole = next(w for w in texts[r.doc_id] if w.count("\n") + 1 == len(r.sections) and len(tk.encode(w, add_special_tokens=False).ids) == r.n_tokens)
        starts = np.cumsum([0, *(len(x) + 1 for x in whole.split("\n")[:-1])])
        e = tk.encode(whole, add_special_tokens=False)
        own = np.searchsorted(starts, [a for a, _ in e.offsets], side="right") - 1
        assert np.bincount(own, minlength=len(starts)).tolist() == [s.n_tokens for s in r.sections] if len(own) else True


def test_token_counts_of_long_blanks(spark):
    """Runs of a million blanks, line feeds and letters neither end the job nor change the ids."""
    ranks = tokencount.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    pool = ["a", "b", " ", "  ", "\n", "\t", "\x85", "\u3000", "1", "'s", "!", "\x1c", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        assert tokencount.encode(enc, t, 2) == enc.encode_ordinary(t), repr(t)
    n = 1_000_000
    rows = [(1, " " * n), (2, "\n" * n), (3, " " * n + "a"), (4, "a" * n), (5, "x" + " \n" * n + "y")]
    made = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), ranks, public_tokenizers.PATTERN, lines=False).collect()
    assert all(r.n_tokens == sum(s.n_tokens for s in r.sections) > 0 for r in made)


def test_long_texts(spark, tables):
    """Texts above a megabyte pass through the narrow operators."""
    rows = [(1, "ab " * 700_000), (2, "a" * 1_500_000), (3, "\n" * 1_200_000), (4, "é" * 800_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made = {r.doc_id: r.n_tokens for r in bpe.encode_column(d, tables).collect()}
    assert made == {i: len(tk.encode(t, add_special_tokens=False).ids) for i, t in rows}
    bench = spark.createDataFrame([(1, "ab " * 20), (2, "a" * 1_500_000)], "item_id long, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.contamination(d, bench).collect()}
    assert hit == {1: (700_000, 700_000), 2: (1, 1), 3: (0, 0), 4: (1, 0)}
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(d, labels).count() == 4
    assert toxicity.grade(d, toxicity.train(d, labels)).count() == 4


def test_border_rules():
    a, b = np.array([0, 2, 5]), np.array([2, 5, 6])
    give = lambda rule: tokencount.allocate(a, b, np.array([0, 3, 4]), 6, rule)[0].tolist()
    assert give("first") == [2, 0, 1]
    assert give("last") == [1, 0, 2]
    assert give("most") == [2, 0, 1]


# --- decontamination ---------------------------------------------------------


def brute_contamination(docs, bench):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in bench:
        w = pattern.findall(low(t or ""))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    out = collections.Counter()
    for i, t in docs:
        w = pattern.findall(low(t or ""))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit[k : k + n] = [1] * n
        out[i, len(w), sum(hit), len(found), decontam.digest(list(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    return out


def test_decontamination(spark, docs):
    own = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bench = [*own, (900, "same words here"), (901, "one"), (902, None), (903, ""), (904, "x " * 13), (905, "x " * 20), (906, "same words here"), (None, "words here again"), (None, "one two")]
    made = decontam.contamination(docs, spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1)), block_bytes=2000).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in made) == brute_contamination(items(docs), bench)
    none = decontam.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0 OR contaminated").count() == 0
    assert decontam.contamination(spark.createDataFrame([], EMPTY), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    kept = decontam.clean(docs, spark.createDataFrame(own, "item_id long, text string"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_every_shared_span_is_found():
    """Random texts over few words, so that spans overlap, repeat and end anywhere."""
    import pyarrow as pa

    from millrace.llm.textwords import words

    rng = random.Random(4)
    for _ in range(60):
        bench = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))) for i in range(4)]
        texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(6)]
        block = decontam.make_block(bench)
        found = collections.defaultdict(set)
        hits = collections.defaultdict(set)
        for w in words(pa.array(texts), decontam._TABLE, size=40):
            for row, a, b, item in decontam.spans_in(block, w):
                found[w.first + row].add(block.ids[item])
                hits[w.first + row] |= set(range(a, b))
        for k, (_, _, n_hit, n_items, *_rest) in enumerate(next(iter(brute_contamination([(0, t)], bench))) for t in texts):
            assert (len(hits[k]), len(found[k])) == (n_hit, n_items)


# --- near duplicates ---------------------------------------------------------


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, rng, share):
    w = text.split()
    return " ".join(rng.choice(w) if rng.random() < share else x for x in w)


@pytest.mark.parametrize(("k", "small"), [(2, 40), (5, 1)])
def test_near_duplicates(spark, docs, k, small):
    rng = random.Random(k)
    base = next(t for _, t in items(docs) if t and len(t.split()) > 150)
    copies = [(10_000 + j, edited(base, rng, rng.choice([0.0, 0.01, 0.02, 0.04, 0.06, 0.1]))) for j in range(60)]
    passage = " ".join(base.split()[:60])
    others = [(11_000 + j, passage + " " + " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60)))) for j in range(60)]
    rows = spark.createDataFrame(copies + others, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("id", F.lit(0)).withColumn("component_id", F.lit(0))
    made = neardup.near_duplicates(rows, k=k, small=small).collect()
    assert len(made) == rows.count()
    expected = brute_components([x for x in items(rows) if x[0] is not None], k)
    for r in made:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    left = neardup.deduplicated(rows, k=k)
    assert left.columns == rows.columns
    assert {i for i, _ in items(left)} == {i for i, (_, c) in expected.items() if i == c} | {None}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    odd = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "a b c", "")], EMPTY)
    assert sorted(tuple(r)[1:] for r in neardup.near_duplicates(odd).where("doc_id IS NOT NULL").collect()) == [(0, 1, True), (0, 2, True)]


def test_prefix_pairs_need_no_bucket_luck():
    """Circulant coordinates agree about as often as the sets are similar."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    sets = [np.unique(a), np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)]))]
    sig = neardup.signatures(sets, 2048)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.05
    assert neardup.most_different(80) == 72


# --- lines -------------------------------------------------------------------


def brute_lines(rows):
    lines, out = [], {}
    for i, t in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
        for n, line in enumerate(t.split("\n")):
            lines.append((i, n, frozenset(x for x in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if x)))
    gone = set()
    for k, (i, n, w) in enumerate(lines):
        if len(w) >= linededup.MIN_WORDS:
            for j, m, v in lines[:k]:
                if len(v) >= linededup.MIN_WORDS and (j, m) < (i, n) and 100 * len(w & v) >= 80 * len(w | v):
                    gone.add((i, n))
                    break
    for i, t in rows:
        out.setdefault(i, []).append(t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone))
    return {i: sorted(v, key=str) for i, v in out.items()}


def test_line_dedup(spark, docs):
    rng = random.Random(8)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    near = [(20_000 + j, "\n".join(" ".join(rng.choice(["q%d" % rng.randrange(9)]) if rng.random() < 0.08 else x for x in base) for _ in range(2)) + "\nshort line\nshort line") for j in range(60)]
    few = docs.where("doc_id % 4 = 0 OR doc_id > 9000 OR doc_id IS NULL").select("doc_id", "text")
    rows = spark.createDataFrame(near, "doc_id long, text string").unionByName(few).withColumn("no", F.lit(1)).withColumn("n_gone", F.lit("kept"))
    made = linededup.without_repeated_lines(rows, count="n_removed")
    assert made.columns == [*rows.columns, "n_removed"]
    got = collections.defaultdict(list)
    for r in made.collect():
        got[r.doc_id].append(r.text)
    assert {i: sorted(v, key=str) for i, v in got.items()} == brute_lines(items(rows))


def test_line_dedup_of_short_lines(spark):
    """Every line with a word takes part: copies of one to four words go, and four words match five."""
    rows = [(1, "Contents\n\nno no no no no no\na b c\np q r s\nPage 1"), (2, "contents\n \nno\na b c d\np q r s t\npage 2"), (3, "CONTENTS\n\nc b a a\nnew\npage  1\nb c a d")]
    made = linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), count="n_removed")
    left = {r.doc_id: (r.text, r.n_removed) for r in made.collect()}
    assert left == {1: (rows[0][1], 0), 2: (" \na b c d\npage 2", 3), 3: ("\nnew", 4)}


def test_line_dedup_makes_no_row_a_pair(spark, monkeypatch):
    """300 lines that are all nearly similar to each other, some of them similar: no table between holds their pairs."""
    rng = random.Random(3)
    base = [f"word{k}" for k in range(60)]
    lines = []
    for j in range(300):
        at = set(rng.sample(range(60), 4))
        lines.append((j, " ".join(f"new{j}x{k}" if k in at else w for k, w in enumerate(base))))
    rows = spark.createDataFrame(lines, "doc_id long, text string")
    held, keep = {}, linededup.stored

    def counted(df, name):
        out = keep(df, name)
        held[name] = max(held.get(name, 0), out.count())
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    made = {r.doc_id: [r.text] for r in linededup.without_repeated_lines(rows).collect()}
    expected = brute_lines(lines)
    assert made == expected and 0 < sum(t == [""] for t in expected.values()) < 300
    assert max(held.values()) < 2 * 300 * 13, held  # two rows at most for each of a line's 13 keys


def test_line_dedup_of_nothing(spark):
    assert linededup.without_repeated_lines(spark.createDataFrame([], EMPTY)).count() == 0
    with pytest.raises(ValueError):
        linededup.without_repeated_lines(spark.createDataFrame([], EMPTY + ", _gone int"))


# --- classifiers -------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "text")], "doc_id long, text string")
    wide = d.unionByName(odd, allowMissingColumns=True).withColumn("quality", F.lit(1))
    made = quality.classify(wide, labels)
    assert made.count() == wide.count()
    assert made.where("score < 0 OR score > 1 OR score IS NULL OR isnan(score) OR predicted <> CASE WHEN score >= 0.7 THEN 1 ELSE 0 END").count() == 0
    held = made.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert quality.keep_good(wide, labels).columns == wide.columns


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(d, none).collect()] == [0.5, 0.5]
    assert quality.classify(spark.createDataFrame([], EMPTY), none).count() == 0


def test_ordinal_regression_recovers_grades(spark):
    rng = random.Random(1)
    weight = {"awful": 2, "bad": 1, "mild": 0.4}
    rows, grades = [], []
    for i in range(900):
        w = [rng.choice(["awful", "bad", "mild", "fine", *(f"n{j}" for j in range(40))]) for _ in range(12)]
        z = sum(weight.get(x, 0) for x in set(w)) + rng.gauss(0, 0.2)
        rows.append((i, " ".join(w)))
        grades.append((i, int(z > 0.7) + int(z > 1.7) + int(z > 2.7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(grades, "doc_id long, toxic int"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    made = toxicity.grade(docs, model).collect()
    truth = dict(grades)
    assert np.mean([r.grade == truth[r.doc_id] for r in made]) > 0.7
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in made)
    e = np.array([r.expected_severity for r in made])
    assert np.corrcoef(e, [truth[r.doc_id] for r in made])[0, 1] > 0.85


def test_toxicity_edges(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "x" * 100_000, "")], EMPTY)
    made = toxicity.grade(odd, model).collect()
    assert len(made) == 3 and not any(r.toxic for r in made)
    assert toxicity.grade(spark.createDataFrame([], EMPTY), model).count() == 0
    assert toxicity.grade(odd, toxicity.train(docs, labels.limit(0))).where("toxic").count() == 0


# --- conversations and pseudonyms --------------------------------------------


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, None, "eve", "x"), (3, 300, "ann", "late"), (3, 1, None, "who")]
    made = rotation.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(7))).collect()
    by = {(r.conv_id, r.block, r.perspective): r for r in made}
    assert set(by) == {(1, 0, "ann"), (1, 0, "bob"), (None, None, "eve"), (3, 0, "ann"), (3, 1, "ann")}
    a = by[1, 0, "ann"]
    assert a.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n" + "<|assistant|>\nbye<|end|>\n" * 2
    assert [a.rendered[m.start : m.end] for m in a.mask] == ["hi<|end|>", "bye<|end|>", "bye<|end|>"]
    assert (a.n_turns, a.n_learned) == (5, 3)
    b = by[1, 0, "bob"]
    assert "<|user name=ann|>\nhi" in b.rendered and [b.rendered[m.start : m.end] for m in b.mask] == ["<|end|>"]
    assert by[3, 0, "ann"].rendered == "<|user name=unknown|>\nwho<|end|>\n" and by[3, 0, "ann"].mask == []
    assert rotation.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark):
    import datetime

    rng = random.Random(6)
    rows, values = [], []
    for i in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(rng.randrange(12, 19)))
        card = next(body + c for c in "0123456789" if _luhn(body + c))
        day = datetime.date(1, 1, 1) + datetime.timedelta(days=rng.randrange(3652059))
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        phone = f"+1 ({rng.randrange(1000):03}) {rng.randrange(1000):03}-{rng.randrange(10000):04}"
        values.append((card, day, ip, phone))
        wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
        rows.append((i, f"a {card}, {day.isoformat()}; {day.day:02}.{day.month:02}.{day.year:04} {ip} {phone} {wrong} 2023-02-29 {card}"))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "no numbers"), (1002, "no numbers")], "doc_id long, text string")
    made = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, "secret").collect()}
    seen = collections.defaultdict(dict)
    for (i, before), (card, day, ip, phone) in zip(rows, values, strict=True):
        r = made[i]
        assert [f.kind for f in r.found] == ["card", "date_iso", "date_day", "ip", "phone", "card"]
        after = [f.pseudonym for f in r.found]
        assert after[0] == after[5] and _luhn(after[0]) and len(after[0]) == len(card)
        new = datetime.date.fromisoformat(after[1])
        assert after[2] == f"{new.day:02}.{new.month:02}.{new.year:04}"
        assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", after[4]) and all(0 <= int(x) <= 255 for x in after[3].split("."))
        whole = before
        for f in r.found[:5]:
            whole = whole.replace(f.original, f.pseudonym) if f.kind != "card" else whole
        assert r.text.startswith(f"a {after[0]}, {after[1]}; {after[2]} {after[3]} {after[4]} ") and r.text.endswith(f" 2023-02-29 {after[0]}")
        for kind, a, b in (("card", card, after[0]), ("date", day, new), ("ip", ip, after[3]), ("phone", phone, after[4])):
            assert seen[kind].setdefault(a, b) == b
    assert all(len(set(m.values())) == len(m) for m in seen.values())  # different values stay different
    assert made[1000].text is None and made[1000].found == [] and made[1001].text == "" and made[1002].text == "no numbers"
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymised(docs, "another").collect()}
    assert sum(other[i] != made[i].text for i, _ in rows) == len(rows)
    assert pseudonyms.pseudonymised(spark.createDataFrame([], EMPTY), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    """Every value of a small domain is met once."""
    one = spark.range(39 * 181).select((F.col("id") / 181).cast("bigint").alias("a"), (F.col("id") % 181).alias("b"))
    out = one.select(pseudonyms._feistel("k", F.lit("t"), F.lit(39), F.lit(181), F.col("a"), F.col("b")).alias("f")).select("f.*").distinct()
    assert out.where("a BETWEEN 0 AND 38 AND b BETWEEN 0 AND 180").count() == 39 * 181


def test_pipeline_keeps_arrow_batches_small(spark, docs):
    import corpus_pipeline
    from millrace.llm.store import batches_of

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with batches_of(spark, 10_000):
        some = spark.range(2000).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)
        made = corpus_pipeline.as_tokens(spark, some, "")
        assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS
        assert made.count() == 2000
    with batches_of(spark, 7):  # a smaller setting stays
        corpus_pipeline.as_tokens(spark, some, "")
        assert int(spark.conf.get(name)) == 7


def test_bpe_slices_are_small():
    texts = pa.array(["x" * 100_000] * 12)
    assert list(bpe.slices(texts)) == [(0, 5), (5, 10), (10, 12)]


def test_line_dedup_parts_words_without_a_pattern(spark):
    odd = ["a b\tc", "a\x0bb\fc\rd", "\t", " a  a ", "Ä b c", ""]
    made = linededup._hashed(spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, line string"))
    assert "RLIKE" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = [len({w for w in re.split("[ \t\n\x0b\f\r]+" if re.search("[\t\x0b\f\r]", x) else " ", x.lower()) if w}) for x in odd]
    assert [len(r.k) for r in made.orderBy("id").collect()] == want


def test_bpe_keeps_pairs_and_words_met_again(tables, monkeypatch):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choice(["lan", "ch", "eit", "wh", "é", "ß", "the", "%", "or"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 80)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 50_000, raising=False)
    pairs, made = [], []
    whole, word = bpe.BpeTables.compatible, bpe.Encoder.word
    monkeypatch.setattr(bpe.BpeTables, "compatible", lambda self, left, right, *limit: pairs.append((left, right)) or whole(self, left, right, *limit))
    monkeypatch.setattr(bpe.Encoder, "word", lambda self, w: made.append(w) or word(self, w))
    fresh = bpe.Encoder(pickle.loads(pickle.dumps(tables)))
    for a, b in zip(words[::2], words[1::2], strict=True):
        assert fresh.encode(f"often {a} {b}") == np.array(tk.encode(f"often {a} {b}", add_special_tokens=False).ids, "<u4").tobytes()
    assert len(pairs) == len(set(pairs))  # a pair is decided once, not once a word
    assert made.count("often") == 1  # what is met again outlasts the cache's turn
    assert len(fresh.words) + len(fresh.older) <= 80


def test_pipeline_gives_the_drivers_memory_back(spark, docs, monkeypatch):
    import corpus_pipeline

    given, give = [], corpus_pipeline.give_back
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda s: given.append(give(s)))
    monkeypatch.setattr(corpus_pipeline, "keep_batches_small", lambda *_: 1 / 0)
    for _, stage in corpus_pipeline.STAGES[3:]:
        with pytest.raises(ZeroDivisionError):  # given back before anything else
            stage(spark, docs, DATA)
    assert given == [True, True]
    monkeypatch.setattr(corpus_pipeline.linededup, "without_repeated_lines", lambda d: d)
    corpus_pipeline.no_repeated_lines(spark, docs.withColumn("n_chars", F.length("text")), DATA)
    assert given == [True] * 3


def test_rarity_is_counted_in_the_fast_table(spark, monkeypatch):
    name, held = "spark.sql.codegen.aggregate.fastHashMap.capacityBit", []
    before = spark.conf.get(name, None)
    rows = type(spark.range(0)).toLocalIterator
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda self, *a, **b: held.append(spark.conf.get(name, None)) or rows(self, *a, **b))
    found = linededup.rarity(spark.createDataFrame([([1, 2],), ([2],), ([2],)], "k array<long>"))
    assert held == [str(linededup.COUNTER_BITS + 1)]  # every counter has room in it
    assert spark.conf.get(name, None) == before
    assert spark.range(1).select(F.slice(found, 1, 4).alias("x")).first().x == [0, 1, 7, 0]


def test_line_dedup_takes_a_text_apart_once(spark, monkeypatch):
    """The text is split once, and hashed beneath the generator: once a document, not once a line."""
    plans, keep = {}, linededup.stored

    def planned(df, name):
        plans[name] = df.select("*")._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(linededup, "stored", planned)
    before = spark.conf.get("spark.sql.optimizer.excludedRules", None)
    rows = spark.createDataFrame([(1, "a b c d e\n\nx"), (1, "a b c d e\n\nx"), (2, "a b c d f e\nx"), (3, None), (None, "x")], "doc_id long, text string").repartition(2)
    made = linededup.without_repeated_lines(rows)
    assert sorted(((r.doc_id, r.text) for r in made.collect()), key=str) == [(1, "a b c d e\n\nx")] * 2 + [(2, ""), (3, None), (None, "x")]
    for name in ("words", "hashes"):
        assert plans[name].count("split(text") == 1, name
        assert 0 < plans[name].index("Generate posexplode") < plans[name].index("xxhash64(text"), name
    assert spark.conf.get("spark.sql.optimizer.excludedRules", None) == before


def test_line_dedup_keys_and_bitmaps(spark):
    """Keys are known not to be null, so they are sorted as numbers; the bitmaps are those of a model."""
    rng = random.Random(4)
    words = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 95, 96, 300)]
    table = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, k array<long>")
    keyed = linededup._keyed(table, linededup.rarity(table))
    assert keyed.schema["k"].dataType.containsNull is False
    made = keyed.select("id", "k", linededup._bitmap().alias("b"), linededup._bitmap(half=True).alias("b2")).orderBy("id").collect()
    for r in made:
        assert r.k == sorted(r.k) and len(r.k) == len(words[r.id])
        whole = half = 0
        for k in r.k:
            whole ^= 1 << (k & 63)
            half ^= 1 << (k & 63) if k & 64 and len(r.k) >= linededup.LONG else 0
        assert (r.b % (1 << 64), r.b2 % (1 << 64)) == (whole, half)
