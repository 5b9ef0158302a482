"""Secrets, personal data, BPE: brute force, edge cases, exact round trips."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from tickloom.llm import bpe, pii, secrets
from tickloom.llm.queries import vocabulary_path

NONE = hashlib.sha256(b"").hexdigest()


def test_windows_are_the_plain_entropies():
    random.seed(1)
    strings = ["".join(random.choice("abc1230/") for _ in range(random.randint(20, 90))) for _ in range(700)]
    strings += ["".join(random.choice("abcdef0123456789") for _ in range(n)) for n in (1042, 1043, 1044, 5000)]
    for s, got in zip(strings, secrets.window_entropies(strings, 20), strict=True):
        want = [-sum(c / 20 * math.log2(c / 20) for c in (w.count(x) for x in set(w))) for w in (s[i : i + 20] for i in range(len(s) - 19))]
        assert np.allclose(got, want)


def test_base_spans_are_the_literal_patterns():
    random.seed(2)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    access, hexa = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
    bits = ["token", "Secret", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "'", "abc123", "DEADBEEF00", "0123456789abcdef", "ß", "K", "\n", "password"]
    for _ in range(4000):
        t = "".join(random.choice(bits) for _ in range(random.randint(0, 12)))
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12] + [("access", *m.span()) for m in access.finditer(t) if len(m[0]) >= 18] + [("hex", *m.span()) for m in hexa.finditer(t) if len(m[0]) >= 16]
        assert sorted(secrets.base_spans(t)) == sorted(want)


def plain_spans(text):
    """Base and entropy spans of one text, window by window, straight from the definitions."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 12] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    marked = set()
    for cls in secrets.CLASSES:
        for m in re.finditer(f"[{cls.pattern}]+", text):
            run, n = m[0], len(m[0]) - cls.window + 1
            if n < 1 or not re.search("[0-9]", run):
                continue
            for i in range(n):
                w = run[i : i + cls.window]
                bits = -sum(w.count(x) / cls.window * math.log2(w.count(x) / cls.window) for x in set(w))
                calm = any(x.start() <= i and i + cls.window <= x.end() for p in secrets.ALLOWED_FORMS for x in re.finditer(p, run)) or any(i < x.end() and x.start() < i + cls.window for p in secrets.ALLOWED_WORDS for x in re.finditer(p, run))
                pieces = [x for x in re.finditer("[^-_/+=]+", run) if x.start() < i + cls.window and x.end() > i]
                calm = calm or all(re.fullmatch("(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})?[0-9]{0,4}|[0-9]+", x[0]) for x in pieces)
                if bits >= cls.bits - 1e-12 and not calm:
                    marked.add((m.start() + i, m.start() + i + cls.window))
    more = []
    for a, b in sorted(marked):
        if more and a <= more[-1][2]:
            more[-1] = ("entropy", more[-1][1], max(b, more[-1][2]))
        else:
            more.append(("entropy", a, b))
    return base, more


def test_secret_rows_are_the_plain_ones(spark, docs):
    random.seed(31)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789"
    bits = [" ", "\n", "/", "=", "-", "é", "example", "sample", "release-candidate-build-2024", "123e4567-e89b-12d3-a456-426614174000", "token = ", "xxxx", "0123456789", "A", "f", "AKIA"]
    make = lambda: "".join(random.choice(letters) for _ in range(random.choice([4, 18, 24, 40])))
    texts = ["".join(random.choice(bits + [make(), make(), "%040x" % random.getrandbits(160), "%024X" % random.getrandbits(96)]) for _ in range(random.randint(0, 12))) for _ in range(400)]
    texts += [t or "" for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = {r.doc_id: r for r in secrets.secret_scan(docs(*enumerate(texts))).collect()}
    found = 0
    for i, t in enumerate(texts):
        base, more = plain_spans(t)
        show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))
        assert got[i].spans == show(base + more), t
        assert got[i].base_sha256 == hashlib.sha256(show(base).encode()).hexdigest() and (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.KINDS[:3])
        found += len(more)
    assert found > 200


def test_entropy_finds_planted_keys_and_leaves_names_alone():
    random.seed(32)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n, least in ((20, 0.95), (24, 0.97), (32, 0.99), (40, 0.99)):
        keys = ["".join(random.choice(letters) for _ in range(n)) for _ in range(600)]
        keys = [k for k in keys if re.search("[0-9]", k)]
        assert sum(bool(s) for s in secrets.entropy_spans([f"see /sample/path {k} there" for k in keys])) >= least * len(keys)
    behind = [("/sample/" + "".join(random.choice(letters) for _ in range(40))) for _ in range(100)]
    assert sum(map(bool, secrets.entropy_spans(behind))) >= 98
    calm = ["release-candidate-build-2024", "2024-01-02-03-04-05-06-07", "this_is_a_long_variable_name_12", "path/to/some/deeply/nested/file2024", "EXAMPLE" + "ab12cd34ef56gh", "11111111111111111111111", "123e4567-e89b-12d3-a456-426614174000"]
    assert not any(secrets.entropy_spans(calm))


def test_scans_are_linear_in_a_text():
    import time

    random.seed(33)
    field = pii.train(rounds=2)
    took = []
    for n in (1000, 8000):
        t = " ".join("%040x" % random.getrandbits(160) for _ in range(n))
        began = time.perf_counter()
        secrets.entropy_spans([t])
        pii.crf_spans([t], [pii.base_spans(t)], field)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]


def test_secret_scan_edges(spark, docs):
    random.seed(3)
    key = "".join(random.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789+/") for _ in range(40))
    long = "word " * 100_000 + key
    rows = [(1, None), (2, ""), (3, f"see {key} there"), (4, "id 123e4567-e89b-12d3-a456-426614174000 ok release-candidate-build-2024"), (5, 'token = "abcdefghijklmnop"'), (5, 'token = "abcdefghijklmnop"'), (7, "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (6, long), (None, "AKIA" + "Z" * 14)]
    got = {}
    for r in secrets.secret_scan(docs(*rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].base_sha256 == got[2][0].base_sha256 == NONE and got[1][0].spans == ""
    kind, a, b = got[3][0].spans.split(":")
    assert kind == "entropy" and 4 <= int(a) and int(b) <= 44 and int(b) - int(a) >= 20
    assert got[4][0].spans == "" and [r.n_assign for r in got[5]] == [1, 1]
    assert got[7][0].spans == "assign:0:48,entropy:8:48,hex:8:48" or re.fullmatch("assign:0:48,(hex:8:48,)?entropy:\\d+:\\d+(,hex:8:48)?", got[7][0].spans)
    assert got[6][0].spans.startswith("entropy:50") and got[None][0].n_access == 1
    assert secrets.secret_scan(docs(*rows).where("false")).count() == 0


def test_personal_patterns_are_the_literal_ones():
    random.seed(4)
    em, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    for _ in range(20_000):
        t = "".join(random.choice(["a", "1", "25", ".", "@", "-", "+", " ", "_", "(", "4111", "1111", "é", "300", "x.y"]) for _ in range(random.randint(0, 14)))
        want = [("email", *m.span()) for m in em.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))] + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]
        assert sorted(pii.base_spans(t)) == sorted(want), t


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    trans = rng.normal(size=(len(pii.LABELS),) * 2)
    scores = [rng.normal(size=(n, len(pii.LABELS))) for n in (1, 2, 3, 4, 1)]
    for s, got in zip(scores, pii.viterbi(scores, trans), strict=True):
        import itertools

        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(s)), key=lambda p: sum(s[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert list(best) == got.tolist()


def test_slopes_are_those_of_the_enumerated_likelihood():
    import itertools

    rng = np.random.default_rng(8)
    n_labels = len(pii.LABELS)
    emission, trans = rng.normal(size=(4, n_labels)), rng.normal(size=(n_labels, n_labels))
    data = [([[0, 1], [2, 3], [0, 2]], np.array([1, 2, 0])), ([[3]], np.array([4]))]

    def plain(e, t):
        gain = 0.0
        for fs, y in data:
            score = np.array([e[f].sum(0) for f in fs])
            path = lambda p, s=score: sum(s[i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))
            gain += path(y) - np.log(sum(np.exp(path(p)) for p in itertools.product(range(n_labels), repeat=len(y))))
        return gain

    gain, up_e, up_t = pii.slopes(data, emission, trans)
    assert np.isclose(gain, plain(emission, trans))
    for table, up in ((emission, up_e), (trans, up_t)):
        for at in ((0, 0), (2, 1), (3, 4), (1, 2)):
            table[at] += 1e-5
            high = plain(emission, trans)
            table[at] -= 2e-5
            assert np.isclose((high - plain(emission, trans)) / 2e-5, up[at], atol=1e-5)
            table[at] += 1e-5


def test_labels_are_not_from_any_table(spark):
    """No labelled value occurs in a documents table that is at hand."""
    values = [m[2] for line in pii.LABELLED for m in pii._TAG.finditer(line)] + [w for line in pii.LABELLED for w in re.findall("[0-9a-f]{16,}", line)]
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        assert d.where(" or ".join(f"contains(text, '{v}')" for v in values)).count() == 0


def planted(n, seed):
    """Prose with entities that the patterns miss, and look-alikes: [(text, [(kind, start, end)])]."""
    random.seed(seed)
    digits = lambda k: "".join(random.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + digits(14)
        return d + next(x for x in "0123456789" if pii.luhn(d + x))

    words = lambda: " ".join(random.choice("the a of river stone many green walks and over under said quiet".split()) for _ in range(random.randint(2, 9)))
    phone = lambda: f"({random.randint(201, 989)}) {random.randint(200, 999)}-{digits(4)}"
    out = []
    for _ in range(n):
        kind = random.randrange(9)
        parts = {0: [("crf_card", card()), ("crf_card", card())], 1: [("crf_phone", "+1 " + phone()), ("crf_card", card())], 2: [("crf_phone", phone())], 3: [("crf_phone", phone().replace("(", "").replace(") ", "-"))], 4: [("", digits(16))], 5: [("", "%040x" % random.getrandbits(160))], 6: [("", f"{random.randint(1990, 2030)}-0{random.randint(1, 9)}-1{digits(1)}")], 7: [("", f"version {digits(1)}.{digits(1)}.{digits(1)}")], 8: [("", f"{digits(2)} of {digits(4)} for {digits(1)},{digits(3)}.00")]}[kind]
        text, spans = words() + " ", []
        for k, v in parts:
            if k:
                spans.append((k, len(text), len(text) + len(v)))
            text += v + " "
        out.append((text + words(), spans))
    return out


def test_added_spans_on_held_out_text():
    """Precision and recall of what the field adds; the README has the figures that this prints."""
    rows = planted(900, 34)
    texts = [t for t, _ in rows]
    base = [pii.base_spans(t) for t in texts]
    got = pii.crf_spans(texts, base, pii.train())
    want = [pii.free(w, b) for (_, w), b in zip(rows, base, strict=True)]
    n_got, n_want, n_both = sum(map(len, got)), sum(map(len, want)), sum(len(set(g) & set(w)) for g, w in zip(got, want, strict=True))
    print(f"added {n_got}, planted {n_want}, both {n_both}: precision {n_both / n_got:.3f}, recall {n_both / n_want:.3f}")
    assert n_both >= 0.9 * n_got and n_both >= 0.9 * n_want


def plain_personal(text, field):
    """All spans of one text from the definitions: patterns, then best paths over each chain, tried label by label."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    em, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    base = [("email", *m.span()) for m in re.finditer(em, text)] + [("ip", *m.span()) for m in re.finditer(ip, text) if all(int(p) <= 255 for p in m[0].split("."))]
    base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))] + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    more = []
    for a, b in pii.chains(text):
        tokens = list(pii._TOKEN.finditer(text, a, b))
        best = None  # by label: (score, labels)
        for fs in pii.features([pii.shape(m[0]) for m in tokens]):
            e = [sum(field.emission[field.rows[f], y] for f in fs if f in field.rows) for y in range(len(pii.LABELS))]
            best = [(e[y], [y]) for y in range(len(e))] if best is None else [max(((s + field.transition[p[-1], y] + e[y], [*p, y]) for s, p in best), key=lambda x: x[0]) for y in range(len(e))]
        labels = [pii.LABELS[y] for y in max(best, key=lambda x: x[0])[1]]
        for i, name in enumerate(labels):
            if name[0] == "B":
                j = i + 1
                while j < len(labels) and labels[j] == f"I-{name[2:]}":
                    j += 1
                span = (f"crf_{name[2:]}", tokens[i].start(), tokens[j - 1].end())
                if pii._plausible(span[0], text[span[1] : span[2]]) and not any(x < span[2] and span[1] < y for _, x, y in base):
                    more.append(span)
    return base, more


def test_personal_rows_are_the_plain_ones(spark, docs):
    field = pii.train()
    texts = [t for t, _ in planted(250, 35)] + [t or "" for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = {r.doc_id: r for r in pii.personal_data(docs(*enumerate(texts)), field).collect()}
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])))
    for i, t in enumerate(texts):
        base, more = plain_personal(t, field)
        assert got[i].spans == show(base + more), t
        assert got[i].base_sha256 == hashlib.sha256(show(base).encode()).hexdigest() and (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS[:4])


def test_chains_cut_no_word_and_hold_every_trigger():
    random.seed(36)
    for _ in range(2000):
        t = "".join(random.choice(["a", "bc" * 30, " ", "\n", "7", "@", "word " * 12]) for _ in range(random.randint(0, 25)))
        got = list(pii.chains(t))
        assert all(a == 0 or t[a - 1].isspace() or t[a].isspace() for a, _ in got) and all(b == len(t) or t[b].isspace() for _, b in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False)) and all(any(a <= m.start() < b for a, b in got) for m in re.finditer("[0-9@]", t))


def test_field_learns_its_table_and_new_text(spark, docs):
    field = pii.train()
    wrong = 0
    for line in pii.LABELLED:
        shapes, want = pii._parsed(line)
        rows = np.array([sum((field.emission[field.rows[f]] for f in fs if f in field.rows), np.zeros(len(pii.LABELS))) for fs in pii.features(shapes)])
        wrong += int((pii.viterbi([rows], field.transition)[0] != want).sum())
    assert wrong == 0
    text = "two 4012888888881881 4222222222222228 cards, and commit 0beec7b5ea3f0fdbc95d0dd47f3c5bc275da8a33 of 2024"
    got = {r.doc_id: r for r in pii.personal_data(docs((1, None), (2, ""), (3, text), (4, "1" * 300_000), (5, "no data, 3 rooms on 2024-01-02"), (6, "a" * 200_000 + "@" + "b" * 100_000)), field).collect()}
    assert got[3].spans.split(",")[0].startswith("crf_card:4:20") and got[3].n_card == 0
    assert got[1].spans == got[2].spans == got[4].spans == got[5].spans == got[6].spans == "" and got[1].base_sha256 == NONE
    assert pii.personal_data(docs((1, "x")).where("false"), field).count() == 0


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return bpe.load(vocabulary_path()), t


def test_bpe_is_the_librarys(both):
    v, t = both
    random.seed(6)
    bits = ["a", "b", "th", "ing", "the", "'s", "'T", "don't", " ", "\n", "\t", "\x0b", "\x85", "　", "ñ", "é", "É", "Σ", "ΑΣ", "İ", "ß", "日本", "١", "½", "!", "...", "👩‍👩‍👧", "\x00", "\x1c", "�", "<|endoftext|>", "<|startoftext|>", "<|", "12", "́"]
    texts = ["", "a" * 5000, "ab" * 3000, *("".join(random.choice(bits) for _ in range(random.randint(1, 30))) for _ in range(5000))]
    for x, (ids, decoded) in zip(texts, bpe.Encoder(v).encode(texts), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want and decoded == t.decode(want, skip_special_tokens=False), repr(x)


def test_bpe_rows(spark, docs, both):
    got = bpe.encode_documents(spark, docs((1, None), (2, ""), (3, "Hello there"), (3, "Hello there"), (None, "x")), vocabulary_path(), texts=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_tokens == by[2][0].n_tokens == 0 and by[1][0].ids_sha256 == NONE and len(by[3]) == 2 and by[None][0].n_tokens == 1
    assert by[3][0].ids == both[1].encode("Hello there", add_special_tokens=False).ids
    assert bpe.encode_documents(spark, docs((1, "x")).where("false"), vocabulary_path()).count() == 0


def test_forgetting_words_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    monkeypatch.setattr(bpe, "BLOCK", 1)
    e = bpe.Encoder(both[0])
    for _ in range(3):
        assert [len(i) for i, _ in e.encode(["one two", "three <|endoftext|>"])] == [8, 8]
