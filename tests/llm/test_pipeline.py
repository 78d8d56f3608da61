"""The whole pipeline against plain Python on a small table: same documents, tokens and order."""

import hashlib
import math
import re
from fractions import Fraction

DATA = "/root/testdata/sf0.001"


def plain_slots(sizes, block):
    """Earliest deadline first over exact weights, slot by slot."""
    left = {s: -(-n // block) for s, n in sizes.items()}
    weight = {s: Fraction(n**0.5) for s, n in sizes.items()}
    total, done, slots, t = sum(weight.values()), dict.fromkeys(sizes, 0), {}, 0
    while any(left.values()):
        ready = [s for s in sorted(sizes) if left[s] and math.floor(done[s] * total / weight[s]) <= t]
        if ready:
            s = min(ready, key=lambda s: (math.ceil((done[s] + 1) * total / weight[s]), s))
            slots[s, done[s]] = t
            done[s] += 1
            left[s] -= 1
        t += 1
    return slots


def test_run_equals_plain_python(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from calibra.llm.bpe import default_tokenizer
    from calibra.llm.secrets import RULES
    from calibra.llm.toxicity import Restorer, char_model, features_of, fit_lexicon

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((r.doc_id, r.text or "", r.source or "") for r in docs.collect())
    # toxicity, from the fitted parts
    model = char_model(docs)
    lexicon, leak = fit_lexicon(docs, labels, model, 3, 1)
    reader = Restorer(model)

    def toxic(text):
        low, clean = text.lower(), 1 - leak
        for words in [reader.readings(t) for t in dict.fromkeys(low.split())] + [(w,) for w in reader.spaced(low)]:
            clean *= 1 - max((lexicon.get(f, 0.0) for w in words for f in features_of(w)), default=0.0)
        return 1 - clean >= 0.7

    rows = [r for r in rows if not toxic(r[1])]
    # one document of each class of linked shingle sets

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [r for i, r in enumerate(rows) if find(i) == i]

    def masked(text):
        spans = sorted((m.start(), m.end()) for rule in RULES for m in re.compile(rule.pattern, re.ASCII).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        merged = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        return text

    sizes = {s: sum(r[2] == s for r in rows) for s in {r[2] for r in rows}}
    slots, tokenizer, want = plain_slots(sizes, 16), Tokenizer.from_file(default_tokenizer()), {}
    for s in sizes:
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, text) for i, text, source in rows if source == s)
        for n, (_, i, text) in enumerate(own):
            ids = tokenizer.encode(masked(text), add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), slots[s, n // 16] * 16 + n % 16)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.mix_position) for r in cp.run(spark, DATA).collect()}
    assert got == want
