"""Files with several licences, and long files with rare template words far from the passage."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import brute

from merchlake.llm import licences

PASSAGES = [p for _, p, _ in licences.TEMPLATES]


def plain(texts):
    """Labels of templates by every alignment of every text, without an index; and scores."""
    docs = [brute.re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(t)) for t in texts]
    frequency = Counter(w for d in docs for w in set(d))
    weight = lambda w: math.log((len(docs) + 1) / (frequency[w] + 1)) + 1e-3
    out = []
    for words, text in zip(docs, texts):
        found, score = set(brute.licences(text)[4].split(",")) - {""}, 0.0
        for label, passage, phrase in licences.TEMPLATES:
            own = [(p, w) for p, w in enumerate(passage.split()) if w not in licences.STOP]
            sums, agree = defaultdict(float), Counter()
            for i, w in enumerate(words):
                for p, x in own:
                    if w == x:
                        sums[i - p] += weight(w)
                        agree[i - p] += 1
            best = max((s for at, s in sums.items() if agree[at] >= licences.MIN_AGREE), default=0.0)
            share, key = min(1.0, round(best / sum(weight(w) for _, w in own), 9)), phrase.split()
            if share >= licences.MIN_SHARE and any(words[i : i + len(key)] == key for i in range(len(words))):
                found.add(label)
                score = max(score, share)
        out.append((",".join(sorted(found)), score))
    return out


def test_several_licences_in_a_file(spark):
    texts = ["\n\nfiller words between\n\n".join(PASSAGES[k] for k in group) for n in (2, 3, 4) for group in list(combinations(range(len(PASSAGES)), n))[:: (1, 7, 31)[n - 2]]]
    scattered = " x ".join(sorted({w for p in PASSAGES for w in p.split()}))
    texts += [f"{p} {'y ' * 500} {scattered}" for p in PASSAGES]
    texts += [" ".join(w for k, w in enumerate(p.split()) if k % 4) for p in PASSAGES]  # shifted words are no match
    texts += [f"{scattered} " + " ".join(w if k % 5 else "gap" for k, w in enumerate(p.split())) for p in PASSAGES]
    texts += ["some other text"] * 400
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, (labels, score) in enumerate(plain(texts)):
        assert got[k][0] == labels and abs(got[k][1] - score) < 1e-6, texts[k]
    gpl, bsd = next(p for label, p, _ in licences.TEMPLATES if label == "gpl"), next(p for label, p, _ in licences.TEMPLATES if label == "bsd")
    assert {"gpl", "bsd"} <= set(got[texts.index(f"{gpl}\n\nfiller words between\n\n{bsd}")][0].split(","))


def test_every_word_of_a_key_phrase_counts(spark):
    texts = ["permission xx use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             "you may not use this file except in compliance zz qq license you may obtain a copy of the license at http www apache org licenses license 2 0"]
    docs = spark.createDataFrame([*enumerate(texts), *((9 + i, "other text") for i in range(50))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.scan_licences(docs).collect()}
    assert got[0] == "" and got[1] == ""
    whole = spark.createDataFrame([(0, texts[0].replace("xx", "to")), (1, texts[1].replace("zz qq", "with the")), *((9 + i, "other text") for i in range(50))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.scan_licences(whole).collect()}
    assert got[0] == "isc" and got[1] == "apache-2.0"
