import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import re
import tracemalloc
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from loopsight.llm import queries, secret_scan, substrings
from loopsight.llm.components import connected_components
from loopsight.llm.decontaminate import ItemIndex, allowed_edits, benchmark_matches, best_alignment
from loopsight.llm.language_model import score_documents
from loopsight.llm.licenses import TEMPLATES, Template, scan_licenses
from loopsight.llm.common import WordHashes, plain_words
from loopsight.llm.mixing import fit_lengths
from loopsight.llm.near_copies import near_copy_groups
from loopsight.llm.ngram_tables import score_by_tables
from loopsight.llm.quality import quality_posterior
from loopsight.llm.secret_scan import cleaned, redact_secrets, redacted, scan_text
from loopsight.llm.simhash import link_fingerprints
from loopsight.llm.topk import top_k
from loopsight.llm.toxicity import Ftrl, features, held_out, train, training_labels

TINY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_sql_gives(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def groups_of(values, near):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_simhash_query(spark, documents):
    def plain(text):
        words = WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = sorted(documents, key=lambda r: r["doc_id"])
    prints = [plain(r["text"] or "") for r in rows]
    want = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r["doc_id"]: r for r in queries.op5_simhash(spark, TINY).collect()}
    assert len(got) == len(rows)
    for r, p, w in zip(rows, prints, want, strict=True):
        assert got[r["doc_id"]]["fingerprint"] == f"{p:016x}"
        assert got[r["doc_id"]]["component_id"] == rows[w]["doc_id"]


def test_near_copy_groups(spark):
    random = np.random.default_rng(8)
    draw = lambda n: [f"w{x}" for x in random.integers(0, 5000, size=n)]
    texts = [None, "", " ", "one", "One", "two words"]
    for n in (40, 120, 400, 1500):
        for _ in range(8):
            base = draw(n)
            for share in (0.0, 0.003, 0.01, 0.02, 0.06):
                copy = list(base)
                for at in random.choice(n, size=int(share * n) + (share > 0), replace=False):
                    copy[at] = "edited"
                texts.append(" ".join(copy))
    base = draw(300)
    for _ in range(250):  # a crowded group
        copy = list(base)
        for at in random.choice(300, size=3, replace=False):
            copy[at] = draw(1)[0]
        texts.append(" ".join(copy))

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(x) for x in texts]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    want = groups_of(sets, near)
    rows = near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["root"] for r in rows}
    assert len(rows) == len(texts)
    whole = {}
    for i in range(len(texts)):  # nothing is joined that isn't linked
        assert whole.setdefault(got[i], want[i]) == want[i]
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if want[i] == want[j] and near(sets[i], sets[j])]
    assert np.mean([got[i] == got[j] for i, j in linked]) >= 0.95
    assert len({got[i] for i in range(len(texts) - 250, len(texts))}) == 1


def test_near_copies_of_short_texts_lose_no_link(spark):
    random = np.random.default_rng(5)
    texts = []
    for n in (8, 9, 12, 18, 23, 28, 60):
        for _ in range(30):
            base = [f"w{x}" for x in random.integers(0, 5000, size=n)]
            # the longest tail that keeps 0.8: n - 4 shingles of n - 4 + extra
            extra = int((n - 4) / 0.8 + 1e-9) - (n - 4)
            for tail in (extra, extra + 1):
                texts.append((" ".join(base), n, tail))
                texts.append((" ".join(base + [f"x{x}" for x in random.integers(0, 10**9, size=tail)]), n, tail))
    rows = near_copy_groups(spark.createDataFrame([(i, x[0]) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["root"] for r in rows}
    for i in range(0, len(texts), 4):
        assert got[i] == got[i + 1] == got[i + 2] != got[i + 3]


@pytest.mark.parametrize("crowded", [1, 64])
@pytest.mark.parametrize("radius", [1, 2])
def test_crowded_buckets_lose_no_link(spark, crowded, radius):
    random = np.random.default_rng(4)
    seeds = random.integers(0, 2**63, size=8)
    values = {int(x) ^ int(np.bitwise_or.reduce(1 << random.integers(0, 63, size=random.integers(0, 4)))) for x in seeds for _ in range(25)}
    values = sorted(values)
    frame = spark.createDataFrame([(x,) for x in values], "fp long")
    found = connected_components(link_fingerprints(frame, radius, crowded))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = groups_of(values, lambda a, b: (a ^ b).bit_count() <= radius)
    assert [got.get(x, x) for x in values] == [values[w] for w in want]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_knapsack_finds_the_nearest_sum():
    random = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(random.integers(1, 40, size=4))
        counts = random.integers(1, 4, size=len(lengths))
        budget = int(random.integers(0, int((lengths * counts).sum()) + 1))
        taken = fit_lengths(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        sums = {sum(a * b for a, b in zip(lengths, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts))}
        assert abs(int((lengths * taken).sum()) - budget) == min(abs(s - budget) for s in sums)
    taken = fit_lengths(np.arange(1, 500), np.full(499, 1000), 40_000_001.0)
    assert int((np.arange(1, 500) * taken).sum()) == 40_000_001


def test_knapsack_meets_long_documents_and_common_divisors():
    for sizes, budget in (({10000: 1, 20000: 1}, 20000), ({30000: 1, 50000: 1}, 50000), ({9000: 3, 17000: 2}, 34000), ({9000: 2, 12000: 2, 20000: 2}, 40000), ({5000: 1, 6000: 1, 10000: 1}, 11000)):
        lengths, counts = np.array(list(sizes)), np.array(list(sizes.values()))
        assert int((lengths * fit_lengths(lengths, counts, budget)).sum()) == budget
    random = np.random.default_rng(6)
    for _ in range(80):
        unit = int(random.integers(1, 30))
        lengths = np.unique(random.integers(1, 50_000 // unit, size=5)) * unit
        counts = random.integers(1, 4, size=len(lengths))
        budget = float(random.integers(0, int((lengths * counts).sum()) + 1))
        taken = fit_lengths(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        sums = {sum(a * b for a, b in zip(lengths, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts))}
        assert abs(int((lengths * taken).sum()) - budget) == min(abs(x - budget) for x in sums)


def test_mixing_query(spark, documents):
    rows = queries.op7_mixing(spark, TINY).collect()
    again = queries.op7_mixing(spark, TINY).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in documents}
    sizes = Counter()
    for r in documents:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    total, weights, capped = sum(sizes.values()), {}, set()
    for i, s in enumerate(sorted(sizes)):
        weights[s] = i % 3 + 1
    while True:
        unit = (total - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in sizes if s not in capped and weights[s] * unit > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert abs(r["target"] - (3 * sizes[s] if s in capped else weights[s] * unit)) < 1e-6
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for r in rows:
        assert abs(taken[source[r["doc_id"]]] - r["target"]) <= max(2, 0.02 * r["target"])


def test_topk_of_wide_vectors_is_exact_and_saturates(spark):
    random = np.random.default_rng(2)
    choice = [1e30, -1e30, 1e12, 1e6, 1.0, -3.0]
    rows = [(i, [choice[j] for j in random.integers(0, 6, size=4)]) for i in range(60)] + [(100, [1e307, 1.0, 1.0, 1.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7).collect()
    whole = {i: [64 * int(x) for x in v] for i, v in rows if i != 100}
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[c], strict=True))), c) for c in whole if c != q)[:7]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_scores_by_tables_are_the_same(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, " ", "en", "x", 1)], docs.schema))
    one = {r["doc_id"]: r for r in score_documents(docs).collect()}
    other = {r["doc_id"]: r for r in score_by_tables(docs.withColumn("row", F.lit(1))).collect()}
    assert one.keys() == other.keys()
    for k, r in one.items():
        assert r["n_words"] == other[k]["n_words"] and r["log_score"] == pytest.approx(other[k]["log_score"])


def test_automata_find_passages_cut_from_another_text():
    random = np.random.default_rng(11)
    draw = lambda n: [b"w%d" % x for x in random.integers(0, 300, size=n)]
    passage, hashes = draw(120), WordHashes()
    one = [*draw(30), *passage, *draw(20)]
    texts = [[*draw(10), *passage[20:64], *draw(8), *passage[70:120], *draw(3)], [*passage[:34], *draw(40)], [*passage, *passage], draw(90), passage[5:40]]
    shard = substrings.Shard(35, 12)
    for _, at, words in substrings.cut_phrases(one, hashes.of(one), np.arange(30, 30 + 120 - 34), 35, 12):
        shard.add(at, words)
    assert not shard.located(texts[0]).any()  # without automata nothing is found
    shard.compile()
    known = {tuple(passage[i : i + 35]) for i in range(120 - 34)}
    for words in texts:
        want = np.zeros(len(words), dtype=bool)
        for s in range(len(words) - 34):
            if tuple(words[s : s + 35]) in known:
                want[s : s + 35] = True
        assert (shard.located(words) == want).all()


def test_license_query(spark, documents):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r["doc_id"]: r for r in queries.op4_licenses(spark, TINY).collect()}
    for r in documents:
        lower = (r["text"] or "").translate({i: i + 32 for i in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, p) for i in range(len(words)) for p in phrases if words[i : i + len(p.split())] == p.split()]
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"]) == (len(words), len(places))
        assert x["first_word"] == min((i for i, _ in places), default=None)
        assert x["last_word"] == max((i for i, _ in places), default=None)
        base = {phrases[p] for _, p in places}
        assert x["base_labels"] == ",".join(sorted(base)) and base <= {*x["labels"].split(",")} and 0 <= x["score"] <= 1


def test_templates():
    t = Template("one two [[three {{2}}]] {{four|five}} six")
    for text, end in (("one two four six", 4), ("one two three a b five six x", 7), ("one two seven six", None)):
        assert t.match(plain_words(text.encode()), 0) == end
    assert scan_licenses(b"Released under the terms of the MIT License.")["labels"] == "mit"
    assert scan_licenses(b"GNU General Public License, version 3")["labels"] == "gpl-3"


def test_templates_hold_whole_wordings():
    for label, markups in TEMPLATES.items():
        for markup in markups:
            whole = markup
            while (less := re.sub(r"\[\[(?:(?!\[\[|\]\]).)*\]\]", " ", whole, flags=re.DOTALL)) != whole:
                whole = less
            whole = re.sub(r"\{\{(?:\d+|([^}|]*)[^}]*)\}\}", lambda m: m[1] or "someone", whole)
            words = whole.split()
            assert label in scan_licenses(" ".join(words).encode())["labels"].split(",")
            for i in range(len(words)):
                if plain_words(words[i].encode()) and words[i] != "someone":
                    changed = " ".join([*words[:i], "xyzzy", *words[i + 1 :]])
                    assert Template(markup).match(plain_words(changed.encode()), 0) is None
    full = {label: TEMPLATES[label][0].lower() for label in ("mit", "isc", "bsd-2", "bsd-3")}
    assert all('as is"' in x and "liable" in x for x in full.values())
    for v in ("v. 2.0", "version 2.0", "v 2.0"):
        assert scan_licenses(f"subject to the terms of the Mozilla Public License, {v}".encode())["labels"] == "mpl-2"


def test_labels_are_those_of_regular_expressions(documents):
    def expression(markup):
        out = r"(?<!\S)"
        for part in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|(?:(?!\[\[|\]\]|\{\{).)+", markup, re.DOTALL):
            if part in ("[[", "]]"):
                out += "(?:" if part == "[[" else ")?"
            elif part.startswith("{{"):
                inner = part[2:-2].strip()
                words = plain_words(inner.replace("|", " ").encode())
                out += rf"(?:\S+ ){{0,{inner}}}" if inner.isdigit() else "(?:" + "|".join(re.escape(w.decode()) for w in words) + ") "
            else:
                out += "".join(re.escape(w.decode()) + " " for w in plain_words(part.encode()))
        return re.compile(out)

    compiled = [(label, expression(x)) for label, all_ in TEMPLATES.items() for x in all_]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    whole = [re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{(?:(\d+)|([^}|]*)[^}]*)\}\}", lambda m: m[2] or "some body", x)) for all_ in TEMPLATES.values() for x in all_]
    texts = [*(r["text"] or "" for r in documents), *whole, *(f"before {x} between {y} after" for x, y in zip(whole, whole[5:], strict=False))]
    found = 0
    for text in texts:
        plain = " ".join(w.decode() for w in plain_words(text.encode())) + " "
        want = {label for label, e in compiled if e.search(plain)} | {label for p, label in phrases.items() if f" {p} " in f" {plain}"}
        assert set(filter(None, scan_licenses(text.encode())["labels"].split(","))) == want
        found += bool(want)
    assert found > 50


def test_secrets(spark, documents):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in queries.op8_secrets(spark, TINY).collect()}
    for r in documents:
        text = r["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        x = got[r["doc_id"]]
        assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert {*base.split(",")} <= {*x["spans"].split(",")} or not base


def test_nested_layers():
    secret = 'password = "hunter2hunter2"'
    once = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(once.encode())).decode()
    for hidden in (once, packed, urllib.parse.quote(packed, safe=""), base64.b64encode(zlib.compress(packed.encode())).decode()):
        text = f"é before {hidden} after"
        base, spans, _, cut = scan_text(text)
        assert not base and not cut and spans
        assert all(9 <= s and e <= 9 + len(hidden) for s, e, _ in spans)
        assert redacted(text, spans).startswith("é before ") and "[SECRET]" in redacted(text, spans)
    escaped = "x token=" + "".join(f"\\u{ord(c):04x}" for c in "abcdef123456") + " y"
    assert (2, len(escaped) - 2, 0) in scan_text(escaped)[1]
    assert scan_text("p%61ssword=%61bcdefg")[1] == [(0, 20, 0)]
    assert scan_text(None)[:2] == ([], [])


def test_every_copy_of_an_encoded_secret_is_found():
    secret = 'password = "hunter2hunter2"'
    once = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(secret.encode(), mtime=0)).decode()
    twice = base64.b64encode(once.encode()).decode()
    escaped = "".join(f"%{b:02X}" for b in secret.encode())
    for hidden in (once, packed, twice, escaped, urllib.parse.quote(packed, safe="")):
        text = f"a {hidden} b {hidden}\nc {hidden} d"
        places = [m.start() for m in re.finditer(re.escape(hidden), text)]
        spans = scan_text(text)[1]
        assert all(any(at <= s and e <= at + len(hidden) for s, e, _ in spans) for at in places)
        assert redacted(text, spans).count("[SECRET]") == 3
    text = f"{once} and {twice}"  # the second holds the first's content
    assert len(scan_text(text)[1]) == 2


def test_layers_that_are_wrapped_escaped_or_glued():
    secret = 'password = "hunter2hunter2"'
    filler = " ".join(hashlib.sha256(bytes([i])).hexdigest()[:7] for i in range(40))
    wrapped = [base64.encodebytes((("x" * n) + " " + secret + " é").encode()).decode().strip() for n in range(30, 60, 3)]
    for columns in (64, 70):
        once = base64.b64encode((filler + secret + filler).encode()).decode()
        wrapped.append("\n".join(once[i : i + columns] for i in range(0, len(once), columns)))
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        packed = pack((filler + secret).encode())
        wrapped.append(base64.encodebytes(packed).decode().strip())
        wrapped.append(base64.encodebytes(packed).decode().strip().replace("\n", "\\n"))
        wrapped.append("".join(f"%{b:02X}" for b in packed))
        wrapped.append(urllib.parse.quote(packed))
        wrapped.append(urllib.parse.quote_plus(packed))
        wrapped.append("".join(f"\\x{b:02x}" for b in packed))
        wrapped.append(repr(packed)[2:-1])
    wrapped.append(base64.b64encode(gzip.compress(f"caf\xe9 {secret}".encode("latin-1"))).decode())
    wrapped.append(base64.b64encode(gzip.compress(b"one ") + gzip.compress(secret.encode())).decode())
    for glue in ("a/", "ab/", "abc/", "abcd/"):
        wrapped.append(glue + base64.b64encode(secret.encode()).decode())
        wrapped.append(glue + base64.b64encode(gzip.compress(secret.encode())).decode())
    for hidden in wrapped:
        text = f"é before {hidden} after"
        base, spans, _, cut = scan_text(text)
        found = [x for x in spans if x not in base]
        assert not cut and any(k == 0 for _, _, k in found), hidden
        assert all(9 <= s and e <= 9 + len(hidden) + len(" after") for s, e, _ in found)
    assert scan_text("a" * 30 + "\n" + base64.b64encode(secret.encode()).decode() + "\nnext words")[1]


def test_members_raw_deflate_pieces_and_deep_escapes(monkeypatch):
    secret = b'password = "hunter2hunter2" '
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    headerless = raw.compress(b"some words and " * 9 + secret) + raw.flush()
    deep = secret.decode()
    for _ in range(80):
        deep = deep.replace("%", "%25") if "%" in deep else "".join(f"%{ord(c):02x}" for c in deep)
    filler = " ".join(hashlib.sha256(bytes([i % 256, i // 256])).hexdigest()[:7] for i in range(4000)).encode()
    monkeypatch.setattr(secret_scan, "PIECE", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 512)
    payloads = [gzip.compress(b"first") + gzip.compress(b"second") + gzip.compress(secret), headerless, gzip.compress(filler + secret), bz2.compress(filler + secret + filler)]
    for hidden in [*(base64.b64encode(p).decode() for p in payloads), deep]:
        base, spans, _, cut = scan_text(f"é a {hidden} b")
        assert any(k == 0 and 4 <= a and b <= 4 + len(hidden) for a, b, k in spans) and not cut and (not base or hidden is deep)
    monkeypatch.setattr(secret_scan, "INFLATE_BYTES", 5000)
    token = base64.b64encode(gzip.compress(filler + secret)).decode()
    assert scan_text(token)[3] == [(0, len(token))] and cleaned(f"a {token} b") == "a [SECRET] b"


def test_random_nestings_leave_no_secret(spark):
    random = np.random.default_rng(9)
    wraps = (
        lambda x: base64.b64encode(x.encode()).decode(), lambda x: urllib.parse.quote(x, safe=""), lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode(),
        lambda x: "".join(f"\\u{ord(c):04x}" for c in x), lambda x: base64.b64encode(zlib.compress(x.encode())).decode(), lambda x: base64.encodebytes(x.encode()).decode().strip(),
    )
    texts = []
    for _ in range(60):
        inner = f"words before token = {hashlib.md5(random.bytes(4)).hexdigest()} and after"
        for k in random.integers(0, len(wraps), size=random.integers(1, 5)):
            inner = wraps[k](inner)
        copies = [inner] * int(random.integers(1, 4))
        texts.append("start " + "\n and ".join(copies) + " end")
    rows = redact_secrets(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        base, spans, _, cut = scan_text(r["text"])
        assert "[SECRET]" in r["text"] and not base and not spans and not cut


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_and_recall():
    random = np.random.default_rng(2)
    vocab = [f"w{i}".encode() for i in range(400)]
    items = [(i, b" ".join(random.choice(vocab, size=n))) for i, n in enumerate(random.integers(8, 60, size=40))]
    index, found, wanted = ItemIndex(items), 0, 0
    for item_id, words in index.items:
        for _ in range(5):
            copy = list(words)
            for _ in range(allowed_edits(len(words))):
                at = int(random.integers(len(copy)))
                copy[at : at + int(random.integers(2))] = [vocab[int(random.integers(400))]] * int(random.integers(2))
            text = [*random.choice(vocab, size=20), *copy, *random.choice(vocab, size=20)]
            n, start, end = best_alignment(words, text)
            assert n == edits(words, text[start:end])
            assert n == min(edits(words, text[i:j]) for i in range(15, 25) for j in range(i, len(text) + 1)) or len(words) > 20
            if n <= allowed_edits(len(words)):
                wanted += 1
                found += any(m["item_id"] == item_id for m in index.search([text])[0])
    assert wanted > 150 and found >= 0.95 * wanted


def test_decontamination_finds_planted_items(spark):
    items = spark.read.parquet(f"{TINY}/benchmark.parquet")
    planted = [(i, f"zz {r['text']} yy") for i, r in enumerate(items.collect())] + [(1000, "nothing of the kind"), (1001, None)]
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in benchmark_matches(docs, items).collect()}
    assert got[1000] == got[1001] == []
    assert all(r["item_id"] in got[i] for i, r in enumerate(items.collect()))


def test_every_window_near_an_item_is_found(spark):
    items = [(r["item_id"], plain_words(r["text"].encode())) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, "/root/testdata/sf0.01").collect()}
    words = [(r["doc_id"], plain_words((r["text"] or "").encode())) for r in docs.collect()]
    grams: dict = {}
    for item_id, w in items:
        k = allowed_edits(len(w))
        for j in range(k + 1):  # one of k + 1 pieces is untouched by k edits
            a, b = j * len(w) // (k + 1), (j + 1) * len(w) // (k + 1)
            grams.setdefault(b - a, {}).setdefault(tuple(w[a:b]), []).append((item_id, a))
    by_id, want = dict(items), set()
    for doc_id, w in words:
        for n, known in grams.items():
            for s in range(len(w) - n + 1):
                for item_id, a in known.get(tuple(w[s : s + n]), ()):
                    item, k = by_id[item_id], allowed_edits(len(by_id[item_id]))
                    if (doc_id, item_id) not in want:
                        low = max(0, s - a - k)
                        if best_alignment(item, w[low : low + len(item) + 2 * k])[0] <= k:
                            want.add((doc_id, item_id))
    assert want and len(got & want) >= 0.95 * len(want) and got <= want


def test_ftrl_is_that_of_plain_python():
    random = np.random.default_rng(3)
    rows = [(np.unique(random.integers(0, 50, size=8)), int(random.random() < 0.4)) for _ in range(200)]
    model = Ftrl(bits=6, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= (0.0 if i == 64 else 0.3):
            return 0.0
        return -(z[i] - np.sign(z[i]) * (0.0 if i == 64 else 0.3)) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)

    for at, y in rows:
        model.learn(at, y)
        some = [*at.tolist(), 64]
        w = {i: weight(i) for i in some}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in some:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(65)), [weight(i) for i in range(65)])


def test_toxicity_held_out(spark):
    found = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = [r for r in found.collect() if r["held_out"]]
    right = [r["predicted"] == r["toxic"] for r in rows]
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(right) > 0.95 and np.mean(toxic) > 0.7 and np.mean(clean) < 0.02


def test_quality_of_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = queries.op1_quality(spark, "/root/testdata/sf0.1").join(labels.where(held_out(F.col("doc_id"))), "doc_id").collect()
    assert len(found) > 300 and np.mean([r["keep"] == r["quality"] for r in found]) > 0.95


def test_quality_posteriors_are_those_of_plain_python(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = quality_posterior(docs, spark.read.parquet(f"{TINY}/labels.parquet"), F.col("source"), F.col("lang")).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    e = np.array([r["evidence"] for r in rows])
    mean = e.mean()

    def strength(groups, middle):
        n = np.array([len(g) for g in groups], float)
        m, c = np.array([e[g].mean() for g in groups]), np.array(middle)
        within = (n * c * (1 - c)).sum() / n.sum()
        spread = n.sum() - (n * n).sum() / n.sum()
        tau = ((n * (m - c) ** 2).sum() - (len(n) - 1) * within) / spread
        return np.clip(within / tau - 1, 1, 1e4) if tau > 0 else 1e4

    of = lambda key: {k: [i for i, r in enumerate(rows) if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = of(lambda r: r["source"]), of(lambda r: (r["source"], r["lang"]))
    a = strength(list(hosts.values()), [mean] * len(hosts))
    whole = {h: (a * mean + e[g].sum()) / (a + len(g)) for h, g in hosts.items()}
    b = strength(list(paths.values()), [whole[k[0]] for k in paths])
    logit = lambda p: np.log(p / (1 - p))
    for i, r in enumerate(rows):
        g, k = hosts[r["source"]], paths[r["source"], r["lang"]]
        host = (a * mean + e[g].sum() - e[i]) / (a + len(g) - 1)
        path = (b * host + e[k].sum() - e[i]) / (b + len(k) - 1)
        assert r["host_posterior"] == pytest.approx(host) and r["path_posterior"] == pytest.approx(path)
        score = 1 / (1 + np.exp(-(logit(np.clip(e[i], 1e-6, 1 - 1e-6)) + logit(path) - logit(mean))))
        assert r["score"] == pytest.approx(score) and r["keep"] == (score >= 0.5)


def test_pipeline_is_that_of_plain_python(spark, documents):
    """Each stage's decisions by brute force on the documents that the one before kept; the mixture by its targets."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = train(docs, training_labels(spark.read.parquet(f"{TINY}/labels.parquet")))
    at, w, bias = model
    weight = dict(zip(at.tolist(), w.astype(np.float32).tolist(), strict=True))
    score = lambda x: bias + sum(weight.get(i, 0.0) for i in features(plain_words((x or "").encode()), WordHashes()).tolist())
    kept = sorted((r for r in documents if score(r["text"]) < 0), key=lambda r: r["doc_id"])

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    groups = groups_of([shingles(r["text"]) for r in kept], lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    kept = [r for i, r in enumerate(kept) if groups[i] == i]
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    found = ItemIndex(items).search([plain_words((r["text"] or "").encode()) for r in kept])
    kept = [r for r, f in zip(kept, found, strict=True) if not f]
    texts = {r["doc_id"]: cleaned(r["text"] or "") for r in kept}
    sizes = {r["doc_id"]: len(WORD.findall(texts[r["doc_id"]])) for r in kept}
    out = corpus_pipeline.run(spark, TINY).collect()
    assert out and {r["doc_id"] for r in out} <= set(texts) and len({r["doc_id"] for r in out}) == len(out)
    by_source, taken, target = Counter(), Counter(), {}
    for r in kept:
        by_source[r["source"]] += sizes[r["doc_id"]]
    for r in out:
        assert r["text"] == texts[r["doc_id"]] and r["size"] == sizes[r["doc_id"]] and r["taken"] == r["size"] * r["copies"] and 1 <= r["copies"] <= 3
        assert r["source_size"] == by_source[r["source"]] and r["n_chars"] == len(r["text"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    longest = max(sizes.values())
    for s, t in target.items():
        assert t <= 3 * by_source[s] + 1e-6 and abs(taken[s] - t) <= min(longest, 0.02 * t + 2)
    assert all(not (x := scan_text(r["text"]))[0] and not x[1] for r in out)


def test_automata_tell_apart_words_of_one_letter_and_crowds_of_phrases(monkeypatch):
    """Many phrases share a gram; with two letters nearly every place looks like one."""
    random = np.random.default_rng(12)
    draw = lambda n: [b"v%d" % x for x in random.integers(0, 500, size=n)]
    passage, hashes = draw(30), WordHashes()
    ones = [[*draw(40), *passage, *draw(40)] for _ in range(40)]
    texts = [[*draw(9), *one[5 * i % 40 : 60 + i], *draw(5)] for i, one in enumerate(ones)] + [[*one[30:70], *draw(3)] for one in ones] + [draw(100), passage]
    known = {tuple(one[i : i + 35]) for one in ones for i in range(110 - 34)}
    for letters in (2, 64):
        monkeypatch.setattr(substrings, "LETTERS", letters)
        shard = substrings.Shard(35, 12)
        for one in ones:
            for _, at, words in substrings.cut_phrases(one, hashes.of(one), np.arange(110 - 34), 35, 12):
                shard.add(at, words)
        shard.compile()
        assert shard.crowd.shape[1] > 0  # phrases that share a gram aren't grown one by one
        for words in texts:
            want = np.zeros(len(words), dtype=bool)
            for s in range(len(words) - 34):
                if tuple(words[s : s + 35]) in known:
                    want[s : s + 35] = True
            assert (shard.located(words) == want).all()


def test_passages_are_the_same_when_nothing_is_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, " ", "en", "x", 1)], docs.schema))
    want = sorted(map(tuple, substrings.repeated_phrases(docs).collect()))
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, substrings.repeated_phrases(docs).collect())) == want
    assert sum(r[2] for r in want) > 0


def test_a_shard_keeps_little_more_than_the_bytes_of_its_phrases():
    random, most = np.random.default_rng(13), 400
    vocabulary = [b"word%03d" % x for x in range(most)]
    phrases = [b" ".join(vocabulary[x] for x in random.integers(0, most, size=58)) for _ in range(2000)]
    shard = substrings.Shard(35, 12)
    shard.letters.of(vocabulary)
    tracemalloc.start()
    for phrase in phrases:
        shard.add(20, bytes(bytearray(phrase)))
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 3 * sum(map(len, phrases))
    shard.compile()
    assert all(shard.located(phrase.split()).all() for phrase in phrases[:50])
