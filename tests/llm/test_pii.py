import re
from hashlib import sha256

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from nearfield.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_hand(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    tests = (
        (EMAIL, lambda s: True), (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        (CARD, lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))), (PHONE, lambda s: 10 <= len(digits(s)) <= 15))
    return sorted((m.start(), k, m.end()) for k, (p, fine) in enumerate(tests) for m in p.finditer(text) if fine(m[0]))


@given(st.text(alphabet="a1.0@+- ()%2é", max_size=60))
@settings(max_examples=1500, deadline=None)
@example("a@b.c%x@d.e")
@example("a@b@c.d.e.")
@example("1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1")
@example("+1 (988) 555-2485 4337166598464399 4337-1665 9846-4399")
def test_base_rules(text):
    assert pii.base_spans(text) == by_hand(text)


def test_long_runs_take_no_square_time():
    for text in ("a" * 300_000, "1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+" * 100_000, "@" * 100_000):
        pii.base_spans(text)


def graph(*texts):
    return pii.graph(list(texts), [pii.base_spans(t) for t in texts])


def test_messages_on_a_tree_give_exact_marginals():
    rng = np.random.default_rng(0)
    g = graph("a1 b2 c3 d4")  # a chain of four tokens
    assert g.chain == [(0, 1), (1, 2), (2, 3)] and not g.skip
    field = pii.Field(rng.normal(size=(pii.FEATURES + 1, pii.N_LABELS)), rng.normal(size=(pii.N_LABELS, pii.N_LABELS)), np.zeros((pii.N_LABELS, pii.N_LABELS)))
    own = pii._bits(np.array(g.features)) @ field.weights
    joint = own[0][:, None, None, None] + own[1][:, None, None] + own[2][:, None] + own[3]
    for (i, j) in g.chain:
        shape = [1] * 4
        shape[i] = shape[j] = pii.N_LABELS
        joint = joint + field.chain.reshape(shape)
    p = np.exp(joint - joint.max())
    p /= p.sum()
    expected = np.stack([p.sum(axis=tuple(a for a in range(4) if a != i)) for i in range(4)])
    old, pii.ROUNDS = pii.ROUNDS, 80
    try:
        assert np.allclose(field.posterior(g), expected, atol=1e-6)
    finally:
        pii.ROUNDS = old


def test_skip_edges_carry_labels():
    g = graph("call +1 988 555 2485 or x 9885552485 far 9885552485", "9885552485")
    assert g.skip == [(4, 5)] and g.rule[:4] == [4, 4, 4, 4]
    agree = np.full((pii.N_LABELS, pii.N_LABELS), -2.0) + np.eye(pii.N_LABELS) * 4
    weights = np.zeros((pii.FEATURES + 1, pii.N_LABELS))
    weights[-1, 0] = 1.5
    g = graph("mail joe@x.org then JOE@X.ORG, and 77@ and joe@x 12345 twice 12345")
    loose = pii.Field(weights, np.zeros((pii.N_LABELS, pii.N_LABELS)), agree)
    p = loose.posterior(g)
    assert p.shape == (6, pii.N_LABELS) and np.allclose(p.sum(axis=1), 1) and p[0].argmax() == 1
    g.rule[1] = 0  # as if no rule had met the second mention
    assert loose.posterior(g)[1].argmax() == 1
    assert pii.Field(weights, np.zeros((pii.N_LABELS, pii.N_LABELS)), np.zeros((pii.N_LABELS, pii.N_LABELS))).posterior(g)[1].argmax() == 0


def test_one_known_mention_reaches_all():
    """A rule knows one mention of a number, first, in the middle or last of 51; the others look like nothing."""
    agree = np.full((pii.N_LABELS, pii.N_LABELS), -2.0) + np.eye(pii.N_LABELS) * 4
    weights = np.zeros((pii.FEATURES + 1, pii.N_LABELS))
    weights[-1, 0] = 1.5
    field = pii.Field(weights, np.zeros((pii.N_LABELS, pii.N_LABELS)), agree)
    for at in (0, 25, 50):
        g = graph(" and ".join(["9885552485"] * 51))
        assert not any(g.rule)
        assert (field.posterior(g).argmax(axis=1) == 0).all()
        g.rule[at] = 4
        p = field.posterior(g)
        assert (p.argmax(axis=1) == 4).all() and np.ptp(np.delete(p, at, axis=0), axis=0).max() < 1e-6


def test_messages_settle_on_a_long_chain():
    """The label of the first of a hundred neighbours reaches the last one."""
    stay = np.full((pii.N_LABELS, pii.N_LABELS), -20.0) + np.eye(pii.N_LABELS) * 20
    field = pii.Field(np.zeros((pii.FEATURES + 1, pii.N_LABELS)), stay, np.zeros((pii.N_LABELS, pii.N_LABELS)))
    g = graph(" ".join(f"{i % 10}" for i in range(100)))
    g.rule[0] = 2
    assert (field.posterior(g).argmax(axis=1) == 2).all()


def test_batches_do_not_matter():
    texts = ["a@b.c 12 a@b.c", "", "99 99 +1 234 567 8901", "1.2.3.4 x 1.2.3.4"]
    rng = np.random.default_rng(3)
    field = pii.Field(rng.normal(size=(pii.FEATURES + 1, pii.N_LABELS)), rng.normal(size=(pii.N_LABELS, pii.N_LABELS)), rng.normal(size=(pii.N_LABELS, pii.N_LABELS)))
    together = field.posterior(graph(*texts))
    alone = np.concatenate([field.posterior(graph(t)) for t in texts if t])
    assert np.array_equal(together, alone)


TEXTS = [
    None, "", "no data here", "é é bob@mail.example.com, 10.0.0.1", "4337166598464399 and 4337166598464398",
    "+1 (988) 555-2485 " * 3, "write to ann@x.org or bob@localhost " * 4, "x" * 100_000 + " 1.2.3.4", "tel 9885552485",
]


def test_query(docs_of):
    docs = docs_of(TEXTS + ["a@b.c", "a@b.c"], ids=[*range(len(TEXTS)), None, None]).withColumnRenamed("lang", "spans")
    rows = pii.op9_personal_data(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a@b.c" if r.doc_id is None else TEXTS[r.doc_id] or ""
        base = by_hand(text)
        listed = [f"{pii.KINDS[k]}:{i}:{j}" for i, k, j in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in range(4)]
        assert r.base_sha256 == sha256(",".join(listed).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(listed) <= set(spans) and len(set(spans)) == len(spans)
        starts = [(int(s.split(":")[1]), pii.SPAN_KINDS.index(s.split(":")[0])) for s in spans]
        assert starts == sorted(starts)
    assert pii.op9_personal_data(docs.limit(0)).collect() == []


def test_secrets():
    text = 'token = "24be64439e3e49cf" api_key: ab12ab12ab12ab12 keys=123456789012 secret="nodigitsatallhere" tokens 1'
    assert [text[i:j] for i, _, j in pii.secret_spans(text)] == ["24be64439e3e49cf", "ab12ab12ab12ab12"]
    assert pii.secret_spans("") == pii.secret_spans("token=" + "a" * 100_000) == []
    assert pii.secret_spans("password=" + "a1" * 50_000)[0][2] == 100_009


def planted(n, seed):
    """Texts with one mention by the rules and, far from it, others that no rule knows; beside them numbers
    that are nobody's. Returns texts and the places of the unknown mentions."""
    rng = np.random.default_rng(seed)
    number = lambda k: "".join(rng.choice(list("123456789"), k))

    def filler():
        words = [rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(rng.integers(8, 20))]
        words[3] = rng.choice([f"{rng.integers(1900, 2030)}", f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", f"${number(3)}",
                               "1" + number(15)])  # now and then a card by its check digit
        words[5] = rng.choice(["a", "v2", "x86", f"no{number(2)}"])
        words[7] = rng.choice(["alone", f"{number(2)} {number(3)}", f"{number(1)} 1{number(15)} 1{number(15)}"])
        return " ".join(words)

    texts, wanted = [], []
    for i in range(n):
        code, a, b = number(3), number(3), number(4)
        hexes = "".join(rng.choice(list("0123456789abcdef"), 40))
        name = rng.choice(["ann", "bob", "eve"]) + number(2)
        known, others = [
            (f"+1 ({code}) {a}-{b}", [f"{a}-{b}", f"{code}-{a}-{b}", f"1{code}{a}{b}"]),
            (f'token = "{hexes}"', [hexes, f"{hexes}###"]), (f"{name}@mail.example", [f"{name}@localhost", f"{name}@intern"]),
        ][i % 3]
        parts = [known, *(f"see {x} there" for x in others), "none here"]
        text, at = "", []
        for k, part in enumerate(parts):
            text += filler() + " "
            if 0 < k <= len(others):
                at.append((len(text) + 4, len(text) + 4 + len(others[k - 1].rstrip("#"))))
            text += part + " "
        texts.append(text)
        wanted.append(at)
    return texts, wanted


def spans_of(texts):
    return [sorted(pii.base_spans(t) + pii.secret_spans(t)) for t in texts]


def test_the_field_finds_mentions_that_no_rule_knows():
    texts, _ = planted(300, 1)
    field = pii.fit(pii._counts(pii.graph(texts, spans_of(texts))))
    texts, wanted = planted(150, 2)
    known = spans_of(texts)
    g = pii.graph(texts, known)
    found = {(t, i, j) for t, (i, _, j) in pii.added_spans(g, field.posterior(g))}
    unknown = {(t, i, j) for t, at in enumerate(wanted) for i, j in at if not any(a < j and b > i for a, _, b in known[t])}
    hits = len(found & unknown)
    assert len(unknown) > 300 and hits >= 0.9 * len(unknown) and hits >= 0.9 * len(found)


def test_clean_texts_get_nothing():
    texts, _ = planted(300, 1)
    field = pii.fit(pii._counts(pii.graph(texts, spans_of(texts))))
    clean = ["in 2019 and 2019 we sold 4.0 of 3,000 v2 x86 parts " * 3, "7777777 7777777 7777777", "1234567890123456 " * 4]
    assert spans_of(clean) == [[]] * 3
    g = pii.graph(clean, spans_of(clean))
    assert [c for c in pii.added_spans(g, field.posterior(g)) if c[0] != 1] == []


def test_fit_is_the_greatest_pseudo_likelihood():
    """The objective by hand, token by token, and no step from the fitted field makes it greater."""
    texts, _ = planted(60, 3)
    rows = pii._counts(pii.graph(texts, spans_of(texts)))
    field = pii.fit(rows)
    total = 0.0
    for features, label, front, back, others, n in rows.tolist():
        z = [field.weights[-1, y] + sum(field.weights[i, y] for i in range(pii.FEATURES) if features >> i & 1)
             + (field.chain[front - 1, y] if front else 0) + (field.chain[y, back - 1] if back else 0)
             + (field.skip[others - 1, y] if others else 0) for y in range(pii.N_LABELS)]
        total += n * (z[label] - np.log(np.sum(np.exp(z))))
    like = np.where(np.eye(pii.N_LABELS) > 0, 4.0, -4.0)
    size = sum((t**2).sum() for t in (field.weights, field.chain, field.skip - like))
    best = pii.objective(rows, field, 1e-4)
    assert np.isclose(best, total / rows[:, 5].sum() - 0.5e-4 * size)
    assert np.allclose(field.skip, field.skip.T)
    rng = np.random.default_rng(0)
    for _ in range(20):
        step = rng.normal(size=(pii.N_LABELS, pii.N_LABELS))
        moved = pii.Field(field.weights + rng.normal(size=field.weights.shape) / 10, field.chain + step / 10,
                          field.skip + (step + step.T) / 10)
        assert pii.objective(rows, moved, 1e-4) < best + 1e-4
