"""Queries that SQL can't express, and the pipeline, against plain Python on the smallest tables."""

import functools
import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.ml.linalg import Vectors
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import queries, secret_scan
from plumbline.llm.language_id import Classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@functools.cache
def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, text):
    return [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@functools.cache
def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def groups(fps, radius=3):
    """doc_id -> smallest doc_id reachable."""
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in fps}


def packing_faults(rows, wanted):
    """wanted: doc_id -> ids."""
    pieces, sequences, faults = defaultdict(list), defaultdict(list), []
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, ids in wanted.items():
        own = sorted(pieces.pop(d), key=lambda r: r["piece"])
        starts = [r["start"] for r in own]
        ends = [r["start"] + r["length"] for r in own]
        if [r["piece"] for r in own] != [*range(len(own))] or starts != [0, *ends[:-1]] or ends[-1] != len(ids):
            faults.append(d)
        if len(ids) <= 1024 and len(own) != 1 or any(r["length"] != 1024 for r in own[1:]):
            faults.append(d)
        if any(crc(ids[a:b]) != r["ids_crc32"] for a, b, r in zip(starts, ends, own, strict=True)):
            faults.append(d)
    for s, places in sequences.items():
        at = 0
        for offset, length in sorted(places):
            if offset != at:
                faults.append(("sequence", s))
            at += length
        if at > 1024:
            faults.append(("sequence", s))
    return faults + list(pieces), len(sequences)


def test_language_id(spark, docs):
    rows = queries.op2_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_token_store(spark, docs):
    start = 0
    rows = {r["doc_id"]: r for r in queries.op3_token_store(spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in sorted(docs):
        ids = ids_of("word_bpe_49k.json", docs[d])
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_simhash(spark, docs):
    fps = {d: fingerprint(t) for d, t in docs.items()}
    own = groups(fps)
    rows = queries.op8_simhash(spark, SF).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == sorted((d, f"{fps[d]:016x}", own[d]) for d in docs)


def test_packing(spark, docs):
    wanted = {d: ids_of("byte_bpe_50k.json", t) for d, t in docs.items()}
    faults, n = packing_faults([r.asDict() for r in queries.op10_packing(spark, SF).collect()], wanted)
    assert not faults
    assert n <= -(-sum(map(len, wanted.values())) // 1024) + 1


def test_token_counts(spark, docs):
    """The totals are those of the documents that aren't toxic, with one more token a document by the second tokenizer."""
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r["doc_id"] not in toxic:
            for name, (vocabulary, _) in queries.TOKENIZERS.items():
                own = want[r["source"], r["lang"], name]
                own[0] += 1
                own[1] += len(ids_of(vocabulary, r["text"])) - (name == "word_bpe_49k")
    rows = queries.op1_token_counts(spark, SF).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"]] for r in rows} == dict(want) and len(rows) == len(want)


def places_of(text):
    """(place, candidate) of all candidates of a text, place from 0."""
    found = {(m.start(), m[0]) for m in re.finditer(secret_scan.CANDIDATE, text)}
    return found | {(m.start(1), m[1]) for m in re.finditer(secret_scan.ASSIGNED, text, re.A)}


def described(finding, path, before, after):
    """The features of a candidate, in plain Python."""
    low, near, n = finding.lower(), f"{before} {after}".lower(), max(1, len(finding))
    count = lambda p, t: len(re.findall(p, t))
    terms = lambda words: count(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])", near)
    kinds = [r"[0-9]", r"[A-Z]", r"[a-z]", r"[^A-Za-z0-9]"]
    return [
        len(finding), *(count(p, finding) / n for p in kinds), sum(bool(re.search(p, finding)) for p in kinds),
        count(r"(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])", finding) / n, len(set(finding)) / n, count("[aeiou]", low) / n,
        bool(re.search("^[0-9a-fA-F-]+$", finding)), sum(1 for _ in re.finditer(r"(.)\1", finding)) / n,
        1 - len(re.sub("|".join(sorted(secret_scan.DICTIONARY, key=len, reverse=True)), "", low)) / n, bool(re.search(secret_scan.TEST_PATH, path.lower())),
        terms(secret_scan.SPEAKS_FOR), terms(secret_scan.SPEAKS_AGAINST), bool(re.search(r"[:=]\s*[\"']?$", before)), bool(re.search("[\"']$", before) and re.search("^[\"']", after)),
    ]


def test_secret_scan(spark):
    """Every place of every candidate, its score by the forest from features in plain Python, and the verdict."""
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        for at, m in places_of(text):
            before, after = text[max(0, at - 40) : at], text[at + len(m) :][:40]
            score = float(model.predictProbability(Vectors.dense([float(x) for x in described(m, r["source"] or "", before, after)]))[1])
            want.append((r["doc_id"], at + 1, len(m), hashlib.sha256(m.encode()).hexdigest(), round(score, 4), score >= 0.5))
    rows = queries.op9_secret_scan(spark, SF).collect()
    assert sorted((r["doc_id"], r["at"], r["n_chars"], r["sha256"], round(r["score"], 4), r["is_secret"]) for r in rows) == sorted(want) and want


def test_planted_secrets(spark):
    """Secrets of each form planted into documents: nine in ten are found at their places, and what they are mistaken for is left alone."""
    rng = random.Random(21)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] and len(r["text"]) > 200]
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    forms = [
        lambda: ("", "AKIA" + draw(up + "234567", 16)), lambda: ("", "ghp_" + draw(low + up + dig, 36)), lambda: ("password=", draw(dig + "abcdef", 18)), lambda: ("api_key = ", draw(low + up + dig, 32)),
        lambda: ("token: ", draw(low + up + dig + "+/", 40)), lambda: ("secret=", draw(low + up, 22)), lambda: ("password: ", draw(low, 5) + "!" + draw(dig, 3) + "$" + draw(up, 3)), lambda: ("private_key=", draw(low + up + dig + "+/", 700)), lambda: ("Authorization: bearer ", draw(low + up + dig, 44)),
    ]
    decoys = [lambda: ("commit ", draw(dig + "abcdef", 40)), lambda: ("md5 checksum: ", draw(dig + "abcdef", 32)), lambda: ("uuid ", "-".join(draw(dig + "abcdef", n) for n in (8, 4, 4, 4, 12)))]
    rows, planted = [], []
    for k in range(360):
        words = rng.choice(texts).split(" ")
        form = (forms + decoys)[k % 12]
        name, value = form()
        at = rng.randrange(len(words))
        head = " ".join([*words[:at], name])
        rows.append((k, head + value + " " + " ".join(words[at:]), "src"))
        planted.append((k, len(head) + 1, hashlib.sha256(value.encode()).hexdigest(), k % 12 < len(forms)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["at"], r["sha256"]): r["is_secret"] for r in secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_findings(spark))).collect()}
    true = [got.get(p[:3], False) for p in planted if p[3]]
    false = [got.get(p[:3], False) for p in planted if not p[3]]
    assert sum(true) >= 0.9 * len(true) and sum(false) <= 0.1 * len(false), (sum(true), len(true), sum(false), len(false))


def brute_replies(messages):
    """conv_id, turn -> parent_conv, parent_turn, root, depth, place for messages with distinct (conv_id, turn)."""
    marks = re.compile(r"((?:[ \t]*>)+)[ \t]?(.*)")
    key = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    order, bodies, cites = sorted(messages), {}, {}

    def parts(lines):
        whole, found = "\n".join(lines), set()
        for paragraph in re.split(r"\n\s*\n", whole):
            found |= {paragraph, *re.split(r"(?<=[.!?…])\s+", paragraph)}
        return {key(t) for t in found | set(lines) | {whole}} - {""}

    for m in order:
        body, blocks, level = [], [], 0
        for line in messages[m].split("\n"):
            found = marks.fullmatch(line)
            now = found[1].count(">") if found else 0
            if now and not level and body and body[-1].endswith("wrote:"):
                body.pop()
            if now and now != level:
                blocks.append((now, []))
            (blocks[-1][1] if now else body).append(found[2] if now else line)
            level = now
        bodies[m] = parts("\n".join(body).strip("\n").split("\n"))
        cites[m] = [(n, p) for n, lines in blocks for p in parts(lines)]
    up = {}
    for m in order:
        best = {}
        for level, p in cites[m]:
            near = [x for x in order if x[0] == m[0] and p in bodies[x]][:1]
            far = [x for x in order if p in bodies[x]][:1] if len(p.split()) >= 3 else []
            who = near[0] if near and near[0] < m else far[0] if far and far[0][0] < m[0] else None
            if who:
                old = best.get(who, (level, 0))
                best[who] = (min(old[0], level), old[1] + len(p.split()))
        if best:
            up[m] = max(best, key=lambda x: (x[0] == m[0], -best[x][0], best[x][1], x[1], x[0]))
    out = {}
    for m in order:
        root, depth = m, 0
        while root in up and up[root][0] == m[0]:
            root, depth = up[root], depth + 1
        out[m] = [*up.get(m, (None, None)), root[1], depth]
    for c in {c for c, _ in order}:
        for place, m in enumerate(sorted((m for m in order if m[0] == c), key=lambda m: (out[m][2], m[1]))):
            out[m].append(place)
    return out


def test_quote_links(spark, tmp_path):
    """The query on conversations with quotes of whole messages, lines, sentences, short answers and other conversations."""
    rng = random.Random(14)
    word = lambda: rng.choice("river stone light house green water charts noon Tuesday meet report budget agree later".split())
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 7))).capitalize() + rng.choice(".!?")
    messages, raw = {}, {}
    for c in range(25):
        for turn in range(rng.randrange(1, 9)):
            lines = []
            earlier = [m for m in messages if m[0] == c] if rng.random() < 0.8 else list(messages)
            if earlier and rng.random() < 0.8:
                source = raw[rng.choice(earlier)]
                quoted = rng.choice([source, [rng.choice(source)], [rng.choice(re.split(r"(?<=[.!?])\s+", rng.choice(source)))]])
                lines += ["On Monday X wrote:"] * rng.randrange(2) + [rng.choice(["> ", ">", "> > "]) + x for x in quoted]
            raw[c, turn] = [" ".join(sentence() for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 4))]
            messages[c, turn] = "\n".join(lines + raw[c, turn])
    rows = [(c, t, "user", x) for (c, t), x in messages.items()]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): [r[k] for k in ("parent_conv", "parent_turn", "root_turn", "depth", "place")] for r in queries.op5_quote_links(spark, f"file://{tmp_path}").collect()}
    want = brute_replies(messages)
    assert got == want and sum(w[0] is not None for w in want.values()) > 40 and any(w[0] != m[0] for m, w in want.items() if w[0] is not None)


def test_pipeline(spark):
    """Each stage's rows, computed again from its predecessor's."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frame, before = documents, {r["doc_id"]: r["text"] for r in documents.collect()}
    stages = dict(corpus_pipeline.STAGES)
    from plumbline.llm import language_id

    dictionaries = language_id.learn(documents, ~language_id.held_out(documents["doc_id"]))
    predict = Classifier(dictionaries).predict

    def identify(d):
        return {k: t for k, t in d.items() if predict(t)[0] != "und" and predict(t)[1] >= 0.004}

    def dedup(d):
        best = {}
        for k in sorted(d, key=lambda k: (-len(d[k]), k)):
            best.setdefault("".join(c for c in d[k] if c not in " \t\n\x0b\x0c\r"), k)
        return {k: d[k] for k in best.values()}

    def near(d):
        """Five words and a Jaccard similarity of 0.8: the rule for stages on word shingles, whatever op8's query takes."""
        sets = {}
        for k, t in d.items():
            w = t.lower().split()
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        known = sorted(d)
        up = {k: k for k in d}
        root = lambda k: k if up[k] == k else root(up[k])
        for i, a in enumerate(known):
            for b in known[:i]:
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
        gone = {k for k in known if root(k) != k}
        return {k: d[k] for k in d if k not in gone}

    def clean(d):
        import re

        grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())] for i in range(len(w) - 4)}
        items = [g for g in map(grams, benchmark) if g]
        return {k: t for k, t in d.items() if not any(len(g & grams(t)) >= 0.8 * len(g) for g in items)}

    for name, brute in zip(stages, (identify, dedup, near, clean), strict=False):
        frame = stages[name](spark, frame, SF)
        assert frame.columns == documents.columns
        before = brute(before)
        assert {r["doc_id"]: r["text"] for r in frame.collect()} == before
    packed = corpus_pipeline.run(spark, SF).collect()
    faults, _ = packing_faults([r.asDict() for r in packed], {d: ids_of("byte_bpe_50k.json", t) for d, t in before.items()})
    assert not faults
    assert np.all([r["length"] > 0 for r in packed])
