"""The licence scan on the wording of real licence files."""

import pytest

from hopscale.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms
of the GNU Lesser General Public License as published by the Free Software Foundation; either
version 3 of the License, or (at your option) any later version."""

GENUINE = {
    "mit": (MIT, 10),
    "mit, indented by marks": (MIT.replace("\n", "\n * "), 10),
    "mit, words inserted": (MIT.replace("of this software", "of this very fine software").replace("to use, copy", "to freely use, copy"), 10),
    "mit, words left out": (MIT.replace(' (the "Software")', ""), 10),
    "bsd": (BSD, 0),
    "bsd, words inserted": (BSD.replace("1. ", "(1) a. all ").replace("permitted provided", "hereby permitted, provided"), 0),
    "apache-2": (APACHE, 11),
    "isc": (ISC, 0),
    "isc, words inserted": (ISC.replace("modify, and/or", "modify, sell, lend and/or"), 0),
    "gpl-3": (GPL, 2),
    "lgpl-3": (LGPL, 5),
}


def test_genuine_licences(spark):
    rows = [(k, "Some words before. " * times + t) for k, (t, _) in GENUINE.items() for times in (0, 3)]
    got = [(r.k, r._license) for r in licenses.scan(spark.createDataFrame(rows, "k string, text string")).collect()]
    assert len(got) == len(rows)
    for at, (k, x) in enumerate(got):
        label = k.split(",")[0]
        places = [p for p in x.places if p.label == label and not p.base]
        # a notice may have several passages; each is found once, and the first where the notice begins
        assert label in x.labels and places and len({p.template for p in places}) == len(places), k
        first = min(places, key=lambda p: p.word)
        assert all(0.6 <= p.score <= 1 for p in places)
        assert abs(first.word - GENUINE[k][1] - 9 * (at % 2)) <= licenses.SLACK, (k, places)
    exact = {k: x for k, x in got if k in ("mit", "apache-2", "isc", "gpl-3")}
    assert {k: x.score for k, x in exact.items()} == pytest.approx(dict.fromkeys(exact, 1.0))


def test_one_word_does_not_count_for_several(spark):
    # a rare word said again and again agrees with one posting only
    rows = [(w * 12,) for w in ("permission is hereby granted free of charge without restriction ", "merge ", "sublicense merge ")]
    assert [r._license.labels for r in licenses.scan(spark.createDataFrame(rows, "text string")).collect()] == [[], [], []]


def test_every_passage_finds_itself(spark):
    rows = [(k, f"Some words before. {t.text} And some after.", t.label) for k, t in enumerate(licenses.LIBRARY)]
    for r in licenses.scan(spark.createDataFrame(rows, "k int, text string, label string")).collect():
        own = [p for p in r._license.places if p.template == len(licenses.BASE) + r.k]
        assert [(p.label, p.word, p.score) for p in own] == [(r.label, 3, 1.0)], r
        # with one word of each key phrase changed it is found no more
    broken = [(k, t.text.replace(t.keys[0], t.keys[0].rsplit(" ", 1)[0] + " otherwise"), t.label) for k, t in enumerate(licenses.LIBRARY)]
    for r in licenses.scan(spark.createDataFrame(broken, "k int, text string, label string")).collect():
        assert not [p for p in r._license.places if p.template == len(licenses.BASE) + r.k], r


def naive(words):
    """(template, place) of every verified alignment by trying all places, one after another; of places within the slack of one another the best."""
    every = (*licenses.BASE, *licenses.LIBRARY)
    postings, need = licenses._index(every)
    found = []
    for t, x in enumerate(every):
        own = [(w, p) for w, ps in postings.items() for n, p in ps if n == t]
        slack = 0 if x.base else licenses.SLACK
        size = len(licenses._words(x.text))
        keys = [" " + " ".join(licenses._words(k)) + " " for k in x.keys] or [" " + " ".join(licenses._words(x.text)) + " "]
        good = []
        for low in range(-size - slack, len(words) + 1):
            hits = [(i, p) for w, p in own for i in range(max(0, low + p), min(len(words), low + slack + p + 1)) if words[i] == w]
            if not any(i - p == low for i, p in hits):
                continue
            n = min(len({p for _, p in hits}), len({i for i, _ in hits}))
            if n < need[t]:
                continue
            times = {}
            for i, p in hits:
                times[i - p] = times.get(i - p, 0) + 1
            at = min(times, key=lambda a: (-times[a], a))
            span = " " + " ".join(words[max(0, at - slack) : max(0, at + size + slack)]) + " "
            if (slack or at >= 0) and all(k in span for k in keys):
                good.append((-n, at))
        kept = []
        for _, at in sorted(set(good)):
            if all(abs(at - a) > slack for a in kept):
                kept.append(at)
        found += [(t, at) for at in kept]
    return sorted(found)


def test_against_a_naive_alignment(spark):
    import random

    r = random.Random(6)
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(licenses.LIBRARY + licenses.BASE).text.split()
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + ["other"] + w[at:], w[:at] + w[at + 1 :], w[:at] + [r.choice(w)] + w[at:]]) or ["x"]
            parts.append(" ".join(w))
        rows.append((" and ".join(parts),))
    rows += [("",), (None,), ("the the the license " * 30,)]
    for x in licenses.scan(spark.createDataFrame(rows, "text string")).collect():
        assert sorted((p.template, p.word) for p in x._license.places) == naive(licenses._words(x.text or "")), x.text
