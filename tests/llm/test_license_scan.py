import random
import re
from re import _parser

from tracelake.llm.license_scan import PHRASES, license_scan, phrase_places, scanner

SCHEMA = "doc_id long, text string, labels string, score string"
LINES = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "mit license MIT licensed", "cc by cc by", "gnu general public licence", "mit der lizenz", "Apache helicopter", "apache LICENSE apache license", "é", "wörd"]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({p[1] for p in places}))


def test_base_against_brute_force(spark):
    random.seed(2)
    rows = [(k, " ".join(random.choice(LINES) + random.choice(["", "\n", ".", "-", " "]) for _ in range(random.randint(0, 8))), "x", "y") for k in range(200)]
    rows += [(None, None, None, None), (1, "", "x", "y"), (2, "mit license " * 30_000, "x", "y"), (2, "mit license", None, None)]
    got = license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((r[0], *brute(r[1]))) for r in rows)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrase_places("cc by") == (2, [(0, "cc-by")])


def labels(text):
    return [d[2] for d in scanner().detections(text.lower())]


def test_signatures():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]  # the plain name lies within
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("CC BY-NC-SA") == ["cc-by-nc-sa"]
    assert labels("the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("GNU General Public License version 2 or later") == ["gpl-2.0-or-later"]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0-or-later"]
    assert labels("under GPLv3+ and the BSD 3-clause") == ["gpl-3.0-or-later", "bsd-3-clause"]
    assert labels("https://creativecommons.org/licenses/by-sa/3.0/") == ["cc-by-sa-3.0"]
    assert labels("Mozilla Public License 2.0; Eclipse Public License v1.0") == ["mpl-2.0", "epl-1.0"]
    assert labels("mit der zeit, apache helicopters and a general public") == []
    assert len(scanner().rules) > 300
    # every keyword stands in what its pattern asks for, so the prefilter hides no match
    assert all(isinstance(r.keyword, str) and r.keyword == r.keyword.lower() for r in scanner().rules)


def example(rng, parsed):
    """A text that the parsed pattern asks for, its choices taken at random."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            kind, arg = rng.choice([a for a in arg if str(a[0]) != "NEGATE"])
            out += chr(arg) if str(kind) == "LITERAL" else rng.choice("\n ") if "SPACE" in str(arg) else "7"
        elif kind == "NOT_LITERAL":
            out += "7"
        elif kind == "BRANCH":
            out += example(rng, rng.choice(arg[1]))
        elif kind == "SUBPATTERN":
            out += example(rng, arg[-1])
        elif kind == "MAX_REPEAT":
            out += "".join(example(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
        else:
            assert kind in ("AT", "ASSERT_NOT"), kind
    return out


def test_prefilter_hides_no_match():
    rng = random.Random(4)
    scan = scanner()
    for rule in scan.rules:
        for _ in range(40):
            text = example(rng, _parser.parse(rule.pattern.pattern))
            assert all(word in text for word in rule.keyword.split()), (rule, text)
    every = type(scan)(scan.rules)
    every.words_of = {keyword: set() for keyword in every.by_keyword}  # each rule runs
    for text in LINES + ["GNU Affero General Public License version 3", "this software is provided as is without any express or implied warranty", "Creative Commons Attribution-ShareAlike 4.0", "in the public domain", "SIL Open Font License 1.1", "PSF License", "Open RAIL"]:
        for gap in (" ", "  ", "\n", "\n# ", "\n * ", "\r\n// "):
            wrapped = text.lower().replace(" ", gap)
            assert scan.detections(wrapped) == every.detections(wrapped)
    assert labels("GNU Affero General Public\nLicense version 3") == labels("gnu affero general public\n# license version 3") == ["agpl-3.0"]
    assert labels("GNU General Public\nLicense, version 3") == ["gpl-3.0"]
    assert labels("This software is provided as is, without any express or implied warranty") == ["zlib"]
    assert labels("Creative\n// Commons  Attribution 4.0") == ["cc-by-4.0"]


def brute_detections(text):
    """Every rule over the whole text, each match kept unless one that comes before it by priority, length and place contains it."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    matches = sorted((-rule.priority, m.start() - m.end(), m.start(), m.end(), rule.label) for rule in scanner().rules for m in rule.pattern.finditer(lowered))
    kept = []
    for priority, _, start, end, label in matches:
        if not any(s <= start and end <= e for s, e, *_ in kept):
            kept.append((start, end, label, -priority))
    return sorted(kept)


def test_labels_and_score_against_brute_force(spark):
    rng = random.Random(8)
    rules = scanner().rules
    lines = LINES + [example(rng, _parser.parse(r.pattern.pattern)) for r in rng.sample(rules, 120)]
    rows = [(k, " ".join(rng.choice(lines) + rng.choice(["", "\n", ". ", " and ", "\n# "]) for _ in range(rng.randint(0, 12))), "x", "y") for k in range(120)] + [(None, None, None, None)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for key, text, *_ in rows:
        found, base = brute_detections(text), set(filter(None, brute(text)[-1].split(",")))
        assert [(d.start, d.end, d.label, round(d.score * 100)) for d in got[key].detections] == found, text
        assert got[key].labels == ",".join(sorted(base | {label for _, _, label, _ in found}))
        assert got[key].score == max([p / 100 for *_, p in found] + [0.7] * bool(base), default=0.0)


def test_signatures_written_by_hand():
    from tracelake.llm.license_rules import SIGNATURES

    assert len(SIGNATURES) > 200 and len({pattern for *_, pattern in SIGNATURES}) == len(SIGNATURES)
    assert labels("See the License for the specific language governing permissions and\n * limitations under the License.") == ["apache-2.0"]
    assert labels("The above copyright notice and this permission notice shall be included in all copies") == ["mit"]
    assert labels("You should have received a copy of the GNU Lesser General Public License") == ["lgpl"]
    assert labels("EUPL, CERN Open Hardware Licence; Blue Oak Model License 1.0.0") == ["cern-ohl", "blueoak-1.0.0"]


def test_gaps_of_any_length():
    """Blanks, line ends and comment marks between a signature's words, 1 to 200 of them, change no label."""
    rng = random.Random(6)
    texts = ["apache license, version 2.0", "gnu general public license version 3", "permission is hereby granted free of charge to any person obtaining a copy", "mozilla public license version 2.0", "gnu lesser general public license version 2.1 or any later version", "creative commons attribution sharealike 4.0", "this software is provided as is without any express or implied warranty", "sil open font license 1.1", "redistribution and use in source and binary forms"]
    for text in texts:
        found = labels(text)
        assert found, text
        for _ in range(30):
            wide = re.sub(" ", lambda _: "".join(rng.choice(" \t\n*#/") for _ in range(rng.randint(1, 200))), text)
            assert labels(wide) == found, wide
    assert labels("permission is hereby\n" + 17 * " " + "granted, free of charge, to any person obtaining a copy") == ["mit"]
    assert labels("apache" + " " * 1_000_000 + "license") == ["apache"]
