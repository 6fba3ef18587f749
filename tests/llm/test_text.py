"""BPE, secrets, chat windows, decontamination, similarity joins, search, the pipeline."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests import oracle
from tests.llm.conftest import FOLDER, long_text, no_python, table
from thermal_lake.llm import bpe, chat_format, decontaminate, jaccard_join, queries, secret_scan, topk

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


TRICKY = [
    None, "", "   ", "Hello, WORLD it's", "a<|endoftext|>b <|startoftext|>", "é ΟΔΟΣ x²½ \x1c a\x1cb don't we'll", "I'LL I'ſ ǅ İx é ́a ᠎ q​z", "日本語 \U0001f600!!", "\u0000x", "a" * 300, "it's's 'tis '' 're",
    "<|endoftext", "naïve café", "tab\tnew\nline\x0b\x0c\x85\xa0　end",
]


def test_bpe_equals_the_library(spark, library, docs, odd):
    codec = bpe.Codec(bpe.Vocabulary.load(queries.tokenizer_path()), remembered=50)
    texts = TRICKY + [r["text"] for r in docs.limit(60).collect()]
    for t in texts:
        e = library.encode(t or "", add_special_tokens=False)
        assert codec.encode(t) == e.ids
        assert codec.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    got = bpe.encode_decode(odd, queries.tokenizer_path()).collect()
    assert len(got) == odd.count()
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        e = library.encode(r["text"] or "", add_special_tokens=False)
        want[r["doc_id"], tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert all(r["ids_sha256"] == sha(" ".join(map(str, r["ids"]))) and r["decoded_sha256"] == sha(r["decoded"]) and r["n_tokens"] == len(r["ids"]) for r in got)


def test_bpe_of_nothing(spark, empty):
    r = bpe.encode_decode(empty, queries.tokenizer_path(), ids=False, decoded=False)
    assert r.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert r.count() == 0


def plain_spans(text):
    out = []
    for kind, pattern, ok in (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return secret_scan.joined(out)


def test_base_spans_are_exact(spark, docs, odd):
    rng = random.Random(4)
    parts = ["token", "TOKEN", "Secret", "api_key", "apikey", "passwd", "password", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "é", "ſecret", "toKen", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(1500)]
    for t in texts:
        assert secret_scan.joined(secret_scan.base_spans(t)) == plain_spans(t)
    for df in (docs, odd):
        want = Counter((r["doc_id"], plain_spans(r["text"] or "")) for r in df.select("doc_id", "text").collect())
        got = secret_scan.scan_secrets(df).collect()
        assert Counter((r["doc_id"], r["base_spans"]) for r in got) == want
        assert all(r["base_sha256"] == sha(r["base_spans"]) and set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(",")) for r in got)


def test_novel_strings(spark, empty):
    random_text = "kT9xQ2vLr8ZpW4mYbN7cJf3H"
    cases = {
        f"the private key material {random_text} was left here": True,
        "the private key abcdefghijklmnopqrstuvwxyz0123456789 is a placeholder": False,
        f"an unremarkable string {random_text} elsewhere": False,
        "authorization header application1json1text1plain1application1json1text": False,
    }
    novelty = secret_scan.Novelty()
    for text, found in cases.items():
        assert bool(secret_scan.novel_spans(text, novelty, [])) == found
    seen = f"{random_text} {random_text} key {random_text}"
    spans = secret_scan.novel_spans(seen, novelty, [])
    assert not any(s > 40 for s, _, _ in spans)
    assert secret_scan.scan_secrets(empty).count() == 0
    assert secret_scan.redact("a token=abcdef b", [(2, "assign", 14)]) == "a [assign] b"


def test_repeated_and_long_secrets_are_novel():
    rng, novelty = random.Random(11), secret_scan.Novelty()
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for size in (40, 700):
        key = "".join(rng.choice(base62) for _ in range(size))
        line = f"the private key material {key} was left here\n"
        assert [s for s, _, _ in secret_scan.novel_spans(line * 3, novelty, [])] == [25 + k * len(line) for k in range(3)]
        text = f"{line}and once more, far from that: {key}."
        assert key not in secret_scan.redact(text, secret_scan.novel_spans(text, novelty, []))
    for _ in range(20):
        long = "".join(rng.choice("0123456789ABCDEF") for _ in range(256))
        assert secret_scan.novel_spans(f"the private key material {long} was left here", novelty, [])


def identifiers_one_by_one(texts):
    counts = Counter()
    for t in texts:
        for word in re.findall(r"[A-Za-z]+_[A-Za-z_]*|[a-z]+[A-Z][A-Za-z]*", t or ""):
            counts.update(p.lower() for p in re.findall(r"[A-Z]?[a-z]{2,14}|[A-Z]{3,15}", word))
    top = sorted(counts, key=lambda p: (-counts[p], p))[: secret_scan.PARTS]
    return " ".join([*reversed(top), secret_scan.IDENTIFIERS])


def novel_one_by_one(text, base, identifiers):
    """Every candidate in its context, one coder at a time."""
    taken = [(int(a), int(b)) for _, a, b in (x.split(":") for x in filter(None, base.split(",")))]
    size = lambda primer, data: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data.encode()))
    keyed = r"[A-Za-z0-9+/_=-]"
    spans, new = [], set()
    for m in re.finditer(rf"{keyed}{{8,}}(?:\.{keyed}{{8,}})+|{keyed}{{16,}}", text):
        x, letters = m[0], re.sub(r"[^A-Za-z]", "", m[0])
        changes = sum(a.isupper() != b.isupper() for a, b in itertools.pairwise(letters))
        odd = len(letters) >= 16 and (re.search(r"(?i)[bcdfghjklmnpqrstvwxz]{5}", letters) or changes >= 0.4 * len(letters))
        if any(a <= m.start() and m.end() <= b for a, b in taken) or not (odd or (letters and re.search(r"\d", x))):
            continue
        spans.append((m.start(), m.end(), x))
        near = text[max(0, m.start() - 64) : m.start()]
        if x in new or not re.search(r"(?i)passw|secret|token|api.?key|private|credential|auth|bearer|access|signature|key", near):
            continue
        after = text[m.end() : m.end() + 512 + len(x) - 1].replace(x, " " * len(x))[:512]
        before = text[max(0, m.start() - 512) : m.start()]
        per = (size(identifiers + after + before, before[-64:] + x) - size(identifiers + after + before, before[-64:])) / len(x)
        bits = 6 if x not in (x.lower(), x.upper()) else 4 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", x) else math.log2(36)
        if per >= (0.6 if len(x) < 64 else 0.1 * bits):
            new.add(x)
    return [(a, "novel", b) for a, b, x in spans if x in new]


def test_novel_spans_by_brute_force(spark, docs, tmp_path):
    rng = random.Random(15)
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    small, big, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    planted = [f"the private key is {key(small + big, 33)} for now", f"bearer {key(small + big + digits, 20)}.{key(small + digits, 40)}.{key(big + small, 25)} sent", f"credential {key(small, 40)} here", "the access key getUserNameFromDatabase is a name", "a secret internationalizationstrategies word", "user_name client_secret privateKeyStore " * 5]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(planted)]
    got = {(r["doc_id"], r["base_spans"]): r["spans"] for r in secret_scan.scan_secrets(table(spark, tmp_path, rows, "doc_id long, text string")).collect()}
    known = identifiers_one_by_one([t for _, t in rows])
    assert "client" in known.removesuffix(secret_scan.IDENTIFIERS).split()
    for i, t in rows:
        base = plain_spans(t or "")
        plain = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in filter(None, base.split(",")))]
        assert got[i, base] == secret_scan.joined([*plain, *novel_one_by_one(t or "", base, known)])
    found = {i: got[10_000 + i, plain_spans(t)] for i, t in enumerate(planted)}
    assert [bool(found[i]) for i in range(6)] == [True, True, True, False, False, False]
    assert found[1].count("novel") == 1


def test_redaction_keeps_rows(spark, odd):
    with_secret = odd.withColumn("text", F.when(F.col("doc_id") == 8, "my token = abcdef012345").otherwise(F.col("text")))
    r = secret_scan.redact_texts(with_secret)
    assert r.columns == odd.columns
    assert r.count() == odd.count()
    x = r.where("doc_id = 8").first()
    assert (x["text"], x["n_chars"]) == ("my [assign]", 11)
    assert r.where("doc_id = 1").first()["text"] is None


def conversations():
    rng = random.Random(5)
    words = ["alpha", "###", "</turn>", "\\", "\\h", "\\l", ":", "#", "é", "\n", "beta:", "<", "", "### user: x</turn>\n"]
    rows = []
    for c in range(40):
        n = rng.randrange(1, 30)
        for t in range(n):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool: #1", None])
            rows.append((c, t, role, None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.choice([1, 5, 60, 400])))))
    rows += [(100, 0, "user", "same"), (100, 0, "user", "same"), (101, None, "assistant", "x"), (None, 0, "assistant", "y"), (102, 0, "system", "only"), (103, 1, "assistant", long_text(60_000))]
    rows += [(200, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(900)]
    # a system turn beyond the budget, one within that is too long to be repeated, one that is repeated, and turns of every size after them
    for c, n in ((300, 3000), (301, 400), (302, 250)):
        rows += [(c, 0, "system", "rule " * n)] + [(c, 1 + t, "assistant" if t % 2 else "user", f"w{t} " * size) for t, size in enumerate((5, 4000, 5, 5000, 60, 60, 250, 262, 509, 510, 511, 512, 1, 1, 120, 126, 127, 3))]
    rows += [(400, 0, "user", f"same turn {t % 3}") for t in range(300)] + [(401, None, "user", "again") for _ in range(300)]
    return rows


def windows_one_by_one(turns):
    """(first new turn, new turns, repeated turns, tokens) of the windows of one conversation's sorted turns."""
    size = [len(re.split(r"\s+", x)) + 2 for _, _, _, x in turns]
    system = turns[0][2] == "system"
    out, used, before = [], 0, 0
    for i, n in enumerate(size):
        segment = before // (16 * 512)
        if i == 0 or segment != last or used + n > 512:
            again = [size[0]] if i and system and size[0] <= 256 and size[0] + n <= 512 else []
            past = [k for k in (i - 2, i - 1) if k >= system]
            for k in (2, 1):
                h = [size[j] for j in past[-k:]]
                if len(h) == k and sum(h) <= 128 and sum(again) + sum(h) + n <= 512:
                    again += h
                    break
            out.append([i + 1, 0, len(again), sum(again)])
            used = sum(again)
        used += n
        out[-1][1] += 1
        out[-1][3] += n
        last = segment
        before += n
    return [tuple(x) for x in out]


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(5)
    w = chat_format.format_windows(df)
    assert no_python(chat_format.digests(w))
    got = {r["conv_id"]: r for r in chat_format.digests(w).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{x}\n" for _, _, role, x in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    windows = w.collect()
    assert Counter(r["conv_id"] for r in windows)[200] > 10
    found = defaultdict(list)
    for r in windows:
        body = r["formatted"]
        assert body.count(chat_format.STOP) == r["n_turns"]
        assert body.count("###") == r["n_turns"]
        assert r["n_tokens"] <= chat_format.BUDGET or (r["n_turns"], r["n_repeated"]) == (1, 0)
        found[r["conv_id"]].append((r["window"], r["n_turns"] - r["n_repeated"], r["n_repeated"], r["n_tokens"]))
        system = by[r["conv_id"]][0]
        if r["window"] > 1 and system[2] == "system" and r["n_repeated"]:
            assert body.startswith("### system: ") == (len(re.split(r"\s+", system[3])) + 2 <= chat_format.SYSTEM_MOST)
    assert {c: sorted(x) for c, x in found.items()} == {c: windows_one_by_one(turns) for c, turns in by.items()}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_chat_order_does_not_depend_on_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr("thermal_lake.operators.graph.HOT_ROWS", 5)
    rows = [x for x in conversations() if x[0] in (200, 302, 400, 401)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = defaultdict(list)
        for r in chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect():
            got[r["conv_id"]].append((r["window"], r["n_turns"] - r["n_repeated"], r["n_repeated"], r["n_tokens"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert {c: sorted(x) for c, x in got.items()} == {c: windows_one_by_one(sorted(x)) for c, x in by.items()}


def test_chat_of_nothing(spark):
    assert chat_format.digests(chat_format.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(docs, items):
    """All pairs whose best aligned run agrees enough, one by one."""
    out = {}
    for i, t in docs:
        ws, at = words(t), defaultdict(list)
        for k, w in enumerate(ws):
            at[w].append(k)
        for j, b in items:
            item = words(b)
            if len(item) < decontaminate.LEAST:
                continue
            n = min(len(item), decontaminate.OVERLAP)
            best = 0
            for shift in {k - q for q, w in enumerate(item) for k in at[w]}:
                same = [int(0 <= shift + q < len(ws) and ws[shift + q] == item[q]) for q in range(len(item))]
                best = max(best, max(sum(same[s : s + n]) for s in range(len(item) - n + 1)))
            if best >= -(-n * decontaminate.AGREE // 1):
                out[i, j] = best
    return out


def test_leaks_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = decontaminate.find_leaks(docs, bench)
    assert no_python(found)
    got = {(r["doc_id"], r["item_id"]): r["agree"] for r in found.collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = leaks([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert want == got
    assert want


def test_leaks_survive_substitutions(spark, odd, empty):
    rng = random.Random(6)
    item = [f"w{i}" for i in range(40)]
    rows, planted = [], 0
    for k in range(60):
        part = list(item)
        for i in range(k % 6, 40, 8):
            part[i] = f"x{k}"
        rows.append((k, " ".join([f"n{rng.random()}" for _ in range(50)] + [w.upper() + "," for w in part] + ["end"] * 20)))
        planted += 1
    rows += [(1000 + k, " ".join(rng.sample(item, 40))) for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "tiny one"), (3, None), (4, "five small words in order"), (4, "five small words in order"), (None, "alpha beta gamma delta epsilon")], "item_id long, text string")
    rows += [(2000, "say five small words in order now"), (2001, "five small words in another order"), (2002, "alpha beta gamma delta epsilon"), (2002, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(k, 1) for k in range(60)} | {(2000, 4), (2001, 4), (2002, None), (None, None)}
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench).count() == 0


def test_leaks_without_a_broadcast(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    a = sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 1)
    assert a == sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench).collect())


def test_masks_meet_every_accepted_overlap():
    """Each set of substitutions that AGREE accepts leaves a window of some mask whole."""
    assert sorted(decontaminate.SHORT_MASKS) == list(range(decontaminate.LEAST, decontaminate.OVERLAP))
    for n in range(decontaminate.LEAST, decontaminate.OVERLAP + 1):
        masks = decontaminate.SHORT_MASKS.get(n, decontaminate.MASKS)
        assert all(m[0] == m[-1] == "1" for m in masks)
        taken = [{at + i for i in decontaminate.offsets(m)} for m in masks for at in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n - math.ceil(n * decontaminate.AGREE)):
            assert any(t.isdisjoint(gone) for t in taken), (n, gone)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WINDOWS, 1])
def test_leaks_of_every_accepted_substitution(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (*range(1, 14), 30)]
    docs = []
    for n, text in items:
        n = min(n, 13)
        for gone in itertools.combinations(range(n), n - math.ceil(n * decontaminate.AGREE)):
            docs.append((len(docs), " ".join(["before", *("x" if k in gone else w for k, w in enumerate(text.split()[:n])), "after"])))
        docs.append((len(docs), " ".join(text.split()[1:n])))
    df = table(spark, tmp_path, docs, "doc_id long, text string")
    items += [(0, ""), (-1, None), (-2, "?!")]
    got = {(r["doc_id"], r["item_id"]): r["agree"] for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == leaks(docs, items)
    assert len(got) == len(docs) - 3  # without a word, only items of 1 to 3 words aren't found


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def similar(rows):
    """class, links by brute force over an inverted index."""
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in index[x])
        for j, n in shared.items():
            if j != k and n / (len(s) + len(sets[j]) - n) >= 0.8:
                links[k] += 1
                parent[max(find(k), find(j))] = min(find(k), find(j))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = Counter()
    for g in groups.values():
        ids = [rows[k][0] for k in g if rows[k][0] is not None]
        for k in g:
            out[rows[k][0], min(ids, default=None), len(g), links[k]] += 1
    return out


def joined(df, **options):
    r = jaccard_join.join(df, **options).collect()
    groups = defaultdict(int)
    for x in r:
        groups[x["class_id"]] += x["is_representative"]
    return Counter((x["doc_id"], x["class_id"], x["class_size"], x["n_links"]) for x in r), groups


def test_similar_documents_by_brute_force(spark, docs):
    got, heads = joined(docs)
    assert got == similar([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert set(heads.values()) == {1}


def near_copies(n=120, seed=7):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w.insert(rng.randrange(len(w)), f"n{rng.randrange(40)}")
        rows.append((k, " ".join(w)))
    other = [f"c{i}" for i in range(60)]
    rows += [(500 + k, " ".join(other[:k] + [f"z{k}"] + other[k + 1 :])) for k in range(0, 60, 3)]
    rows += [(900, "one two"), (901, "ONE  two"), (902, "one"), (903, None), (904, ""), (905, " "), (906, "one two"), (906, "one two"), (None, "one two"), (None, "lonely words here"), (None, None)]
    return rows


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_ROWS, 16])
def test_hot_groups_lose_no_link(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rows = near_copies()
    df = table(spark, tmp_path, [(*r, 1, "k") for r in rows], "doc_id long, text string, row long, rep string")
    got, _ = joined(df, recall=0.99999)
    assert got == similar(rows)


def test_templated_texts_that_chain_lose_no_link(spark, tmp_path, monkeypatch):
    """Texts that share half of their words meet in the tries and make one large component of many classes."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    rng, template, rows = random.Random(23), [f"t{i}" for i in range(80)], []
    for k in range(110):
        own = [f"o{k}x{i}" for i in range(rng.randrange(10, 60))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = [*template, *own]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    got, heads = joined(table(spark, tmp_path, rows, "doc_id long, text string"), recall=0.99999)
    assert got == similar(rows)
    assert len(heads) > 20


@pytest.mark.parametrize("options", [{}, {"recall": 0.5}])
def test_pairs_that_share_no_prefix_are_linked(spark, tmp_path, options):
    """Near copies of one text, at production parameters and where many pairs share no prefix."""
    rows = [r for r in near_copies() if r[0] is not None and r[0] < 500]
    got, _ = joined(table(spark, tmp_path, rows, "doc_id long, text string"), **options)
    assert got == similar(rows)


def test_prefix_is_shortened_until_the_measured_recall_reaches_the_target(spark, tmp_path, monkeypatch):
    lengths = []
    real = jaccard_join.shortened
    monkeypatch.setattr(jaccard_join, "shortened", lambda *a: lengths.append(real(*a)) or lengths[-1])
    rng = random.Random(21)

    def edited(w, n):
        w = list(w)
        for at in rng.sample(range(5, len(w) - 5), n):
            w[at] = f"e{rng.random()}"
        return " ".join(w)

    base = [[f"t{k}w{i}" for i in range(200)] for k in range(400)]
    close = [(2 * k + j, edited(w, j)) for k, w in enumerate(base) for j in range(2)]
    far = [(1000 + 2 * k + j, edited(w, 4 * j)) for k, w in enumerate(base) for j in range(2)]
    for name, rows in (("close", close), ("far", far)):
        (tmp_path / name).mkdir()
        got, _ = joined(table(spark, tmp_path / name, rows, "doc_id long, text string"))
        assert got == similar(rows)
    assert lengths[0] == jaccard_join.DEPTH
    assert jaccard_join.longest_prefix(jaccard_join.TREES, jaccard_join.DEPTH, 0.8, 0.999) <= lengths[1] < jaccard_join.DEPTH
    pairs = np.array([0.99, 0.95, 0.81, 0.82, 0.99]), np.array([8, 8, 5, 8, 8])
    assert jaccard_join.measured_recall(*pairs, 8, 20, 5) == pytest.approx(0.5, abs=1e-3)
    assert jaccard_join.shortened(*pairs, 20, 8, 5, 0.999) == 5
    assert jaccard_join.shortened(*(x[:2] for x in pairs), 20, 8, 5, 0.999) == 8
    assert jaccard_join.shortened(np.empty(0), np.empty(0), 20, 8, 5, 0.999) == 5


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_ROWS, 16])
def test_all_neighbours_measure_the_recall(spark, tmp_path, monkeypatch, block):
    """More than 4096 neighbours: each of them that is similar is counted, in small components and in large ones."""
    counted, real, edges = [], jaccard_join.shortened, jaccard_join.neighbours
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard_join, "shortened", lambda *a: counted.append(int(sum(a[6])) if len(a) > 6 else len(a[0])) or real(*a))
    monkeypatch.setattr(jaccard_join, "neighbours", lambda *a: counted.append(edges(*a).count()) or edges(*a))
    rows = [(120 * k + i, " ".join([f"a{k}x{j}" for j in range(60)] + [f"z{k}y{i}"])) for k in range(14) for i in range(120)]
    got, _ = joined(table(spark, tmp_path, rows, "doc_id long, text string"))
    assert got == similar(rows)
    assert counted[0] == counted[1] > 4096


@pytest.mark.parametrize("most", [jaccard_join.WITH_SETS, 0])
def test_sets_of_small_components_are_shuffled_once(spark, tmp_path, monkeypatch, most):
    """Neighbours and all pairs of a component are verified where its sets are dealt to, however many rows a broadcast may have by itself."""
    monkeypatch.setattr(jaccard_join, "WITH_SETS", most)
    plans, real = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    monkeypatch.setattr(jaccard_join, "verified", None)
    rows = near_copies()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, _ = joined(table(spark, tmp_path, rows, "doc_id long, text string"), recall=0.99999)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == similar(rows)
    (whole,) = (p for n, p in plans if n == "jaccard-whole")
    assert whole.count("Exchange hashpartitioning") == (1 if most else 3)


def test_only_sets_of_large_components_are_shuffled_again(spark, tmp_path, monkeypatch):
    """Neighbours and nodes of a large component are verified without the sets of small ones."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 64)
    met = []
    for name in ("similar_pairs", "verified"):
        real = getattr(jaccard_join, name)
        monkeypatch.setattr(jaccard_join, name, lambda rows, sets, *a, real=real: met.append(sets.count()) or real(rows, sets, *a))
    rows = near_copies()
    got, _ = joined(table(spark, tmp_path, rows, "doc_id long, text string"), recall=0.99999)
    assert got == similar(rows)
    large = {jaccard_join.set_key(jaccard_join.Shingler()(t)) for k, t in rows if k is not None and k < 500}
    assert len(large) > 64
    assert len(met) > 1
    assert max(met) <= len(large)


def test_planted_pairs_at_the_threshold_are_found(spark, tmp_path):
    """Pairs of a similarity of 0.8 to 0.83, far from all others: at least 0.99 of them are linked."""
    rng, rows = random.Random(22), []
    for k in range(700):
        w = [f"p{k}w{i}" for i in range(120)]
        x = list(w)
        for at in (20, 60):
            x[at + rng.randrange(3)] = f"q{rng.random()}"
        x += [f"r{k}{i}" for i in range(rng.randrange(1, 4))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    sims = [len(a & b) / len(a | b) for a, b in ((shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1])) for k in range(700))]
    assert min(sims) >= 0.8
    assert max(sims) < 0.86
    r = jaccard_join.join(table(spark, tmp_path, rows, "doc_id long, text string"))
    assert r.where("n_links = 1 and class_size = 2").count() >= 0.99 * 1400


def test_rows_are_the_same_however_the_table_is_split(spark, tmp_path):
    """The defaults that decide how files are split change between the call and the action."""
    path = str(tmp_path / "split")
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(16).write.parquet(path)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    found = []
    for first, second in ((("4", "128m", "4m"), ("16", "8k", "1k")), (("16", "8k", "1k"), ("4", "128m", "4m"))):
        try:
            for k, v in zip(keys, first, strict=True):
                spark.conf.set(k, v)
            frames = [jaccard_join.deduplicate(spark.read.parquet(path)), jaccard_join.join(spark.read.parquet(path)), decontaminate.drop_leaks(spark.read.parquet(path), bench)]
            for k, v in zip(keys, second, strict=True):
                spark.conf.set(k, v)
            found.append([sorted(map(tuple, f.collect()), key=repr) for f in frames])
        finally:
            for k in keys:
                spark.conf.unset(k)
    assert found[0] == found[1]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(path).collect()}
    classes = similar(list(texts.items()))
    assert [r[0] for r in found[0][0]] == sorted((i for i, c, _, _ in classes if i == c), key=lambda i: repr((i, texts[i])))


def test_similarity_of_odd_rows(spark, odd, empty):
    got, _ = joined(odd)
    assert got == similar([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 5").count() == 1
    assert kept.where("doc_id = 6").count() == 0


def test_recall_bound_and_dense_products():
    length = jaccard_join.longest_prefix(20, 8, 0.8, 0.999)
    assert jaccard_join.met(0.8, 20, length) >= 0.999 > jaccard_join.met(0.8, 20, length + 1)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80))).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]
    assert jaccard_join.intersections(sets[:10], sets[10:]).astype(int).tolist() == want


def test_signatures_estimate_similarity():
    seeds = jaccard_join.seeds_of(32, 8)
    base = jaccard_join.mixed(np.arange(1, 1001, dtype=np.uint64))
    a, b = jaccard_join.signature(np.sort(base[:900]), seeds), jaccard_join.signature(np.sort(base[100:]), seeds)
    assert np.mean(a == b) == pytest.approx(0.8, abs=0.08)


def best(rows, k=5):
    """The k best by sorting all."""
    ok = [(i, [int(np.floor(256 * float(np.float64(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in ok:
        if i % 50 == 0:
            scores = {}
            for j, u in ok:
                if j != i and len(u) == len(v):
                    s = max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, u, strict=True))))
                    scores[j] = max(scores.get(j, s), s)
            for rank, (j, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.add((i, rank, j, s))
    return out


@pytest.mark.parametrize("tile", [topk.TILE, 7])
def test_search_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(300)]
    rows += [(400 + i, [1.0] * 6) for i in range(60)]  # ties
    rows += [(500, None), (550, [1.0, None, 0, 0, 0, 0]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (700, []), (None, [1.0] * 6), (750, [0.5, 0.5]), (751, [0.25, -0.5]), (7, rows[7][1]), (0, rows[0][1])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(6)
    got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == best(rows)


@pytest.mark.parametrize("tile", [topk.TILE, 8])
def test_an_id_that_fills_many_tiles_takes_one_place(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    rng = np.random.default_rng(12)
    rows = [(50, [1.0, 1.0])] + [(k, [float(x) for x in rng.normal(size=2)]) for k in range(1, 40)] + [(7, [9.0 + 0.5 * (k % 5), 9.0]) for k in range(160)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 50).collect()
    assert {tuple(r) for r in got} == best(rows)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 64)
    rows = [(i, [float(i % 7), float(-i)]) for i in range(0, 500, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()} == best(rows)


def test_search_beyond_doubles(spark):
    rows = [(0, [1e14, 1.0]), (1, [1e14, 3.0]), (2, [-1e14, 1.0]), (3, [1e12, 1e12]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()} == best(rows)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    oracle.check(queries.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), queries.ORACLES[name])


def test_pipeline_by_brute_force(spark, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    classes = similar(docs)
    kept = {i for i, c, _, _ in classes if i == c}
    docs = [(i, t) for i, t in docs if i in kept]
    gone = {i for i, _ in leaks(docs, items)}
    assert gone
    novelty = secret_scan.Novelty(identifiers_one_by_one([t for i, t in docs if i not in gone]))
    want = {}
    for i, t in docs:
        if i not in gone:
            base = secret_scan.base_spans(t)
            clean = secret_scan.redact(t, [*base, *secret_scan.novel_spans(t, novelty, base)])
            want[i] = tuple(library.encode(clean, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: tuple(r["ids"]) for r in got} == want
    assert len(got) == len(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "secret_scan", "bpe"]


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


def test_names_of_the_queries():
    names = "toxicity quality brown_score decontaminate chat_format bpe topk language_id secret_scan jaccard_join".split()
    assert list(queries.QUERIES) == [f"op{n}_{name}" for n, name in enumerate(names, 1)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
