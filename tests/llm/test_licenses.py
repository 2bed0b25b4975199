import re

from arborlake.llm import licenses as lic

R = lic.Recogniser()


def found(text):
    return [x for _, x in R.licences(R.sentences(text)[1])]


def test_notices():
    assert found("Some words.\nReleased under the MIT License.\nMore words here.") == ["MIT"]
    assert found("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert found("LICENSED under   cc by-nc 4.0.") == ["CC-BY-NC-4.0"]
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0-only"]
    assert found("x. All rights reserved.\ny All rights reserved. Z") == ["LicenseRef-all-rights-reserved"]
    assert found("The program licensed under CC BY 4.0 is good.") == []
    assert found(None) == found("") == []


def wrapped(ids, width=60):
    text = ". ".join(lic.SENTENCES[i] for i in ids) + "."
    out, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line += w + " "
    return "\n".join([*out, line])


def test_whole_texts():
    for name, ids in lic.RULES:
        assert found("Intro line one.\n\n" + wrapped(ids) + "\nOutro.") == [name], (name, ids)
        assert found("\n".join(lic.SENTENCES[i] + "." for i in ids)) == [name]
    assert found(lic.SENTENCES["bsd-redistribution"] + " " + lic.SENTENCES["bsd-source"] + ".") == []


def test_sentences_against_brute_force():
    """Each text of whole known and unknown sentences, one a line: identifiers are those of equal lines."""
    import random

    rnd = random.Random(1)
    by_words = {tuple(re.findall("[a-z0-9]+", s.lower())): i for i, s in lic.SENTENCES.items()}
    pool = [s.rstrip(".:") for s in lic.SENTENCES.values()] + ["Erth onst ing", "MIT", "The cat", "Permission denied"]
    for _ in range(200):
        own = [rnd.choice(pool) for _ in range(rnd.randrange(8))]
        want = [by_words[w] for s in own if (w := tuple(re.findall("[a-z0-9]+", s.lower()))) in by_words]
        assert [i for _, i in R.sentences("\n".join(s + "." for s in own))[1]] == want


def test_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, "x"), (4, "Word here. " * 20000 + "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, licences string")
    got = sorted(((r.doc_id, r.n_sentences, r.licences) for r in lic.scan(df).collect()), key=str)
    assert got == sorted([(1, 1, ["MIT"]), (1, 1, ["MIT"]), (2, 0, []), (3, 0, []), (None, 1, []), (4, 20001, ["CC-BY-NC-4.0"])], key=str)
    assert lic.scan(df.limit(0)).count() == 0


def test_broken_and_late_sentences():
    """Rules, indents and foreign text before a sentence, and any number of pieces in it."""
    for before in ("-" * 300, " " * 300, "Ö" * 300 + " "):
        assert R.sentences(before + "Released under the MIT License")[0] == 1
        assert found(before + "Released under the MIT License") == ["MIT"]
    name, ids = lic.RULES[0]
    text = "\n".join(lic.SENTENCES[i] for i in ids)
    assert found("!! ".join(text.split())) == found("\n\n".join(text.split())) == [name]


def brute(text):
    """Licences by trying each rule at each place over the pieces, longest rules first."""
    pieces = [tuple(re.findall("[a-z0-9]+", p.lower())) for p in re.split(r"\n|[.!?;:](?=\s)", text)]
    pieces = [p for p in pieces if p]
    known = sorted(((tuple(re.findall("[a-z0-9]+", s.lower())), i) for i, s in lic.SENTENCES.items()), key=lambda x: -len(x[0]))
    seen, at = [], 0
    while at < len(pieces):
        for words, i in known:
            ends = [e for e in range(at + 1, len(pieces) + 1) if sum(pieces[at:e], ()) == words]
            if ends:
                seen.append((at, ends[0], i))
                at = ends[0]
                break
        else:
            at += 1
    out, k = [], 0
    while k < len(seen):
        for name, ids in sorted(lic.RULES, key=lambda r: -len(r[1])):
            own = seen[k : k + len(ids)]
            if [x[2] for x in own] == ids and all(b[0] - a[1] <= lic.GAP for a, b in zip(own, own[1:])):
                out.append(name)
                k += len(ids)
                break
        else:
            k += 1
    return out


def test_rules_against_brute_force():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            ids = list(rnd.choice(lic.RULES)[1])
            if rnd.random() < 0.3:
                rnd.shuffle(ids)
            for i in ids[: rnd.randint(1, len(ids))]:
                parts += [lic.SENTENCES[i], *[f"Unknown {k}" for k in range(rnd.choice([0, 0, 1, lic.GAP, lic.GAP + 1]))]]
        text = ".\n".join(parts)
        words = text.split(" ")
        text = " ".join(w + ("\n" if rnd.random() < 0.05 else "") for w in words)
        assert found(text) == brute(text)
