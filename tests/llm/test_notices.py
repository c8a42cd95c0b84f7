"""op10: base places word by word, and planted notices with edits."""

import random
import re
from collections import Counter

from helpers import documents, prose

from slidegrid.llm import notices as N


def plain_base(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in N.BASE for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_places(spark):
    extra = [
        (1, "Under the MIT License. under_the-mit/LICENSE x", "en", "s"), (2, "Apache License, Version 2.0 and CC BY-NC 4.0", "en", "s"), (3, "cc by nc by nc cc by ncx", "en", "s"),
        (4, "\u00c9under the mit license", "en", "s"), (5, "Apache License, Version 20", "en", "s"),
    ]
    for docs in (documents(spark), documents(spark, extra)):
        want = Counter((r["doc_id"], *plain_base(r["text"])) for r in docs.collect())
        got = N.scan(docs).collect()
        assert Counter((g["doc_id"], g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got) == want
        for g in got:
            assert set(filter(None, g["base_labels"].split(","))) <= set(filter(None, g["labels"].split(","))) and 0 <= g["score"] <= 1
    assert N.scan(documents(spark, [])).count() == 0


def test_pieces_cover_the_phrase():
    for n in N.NOTICES:
        parts = N.pieces(n.phrase, n.edits)
        assert len(parts) == n.edits + 1 and "".join(p for _, p in parts) == n.phrase and all(n.phrase[a:].startswith(p) for a, p in parts)


def test_edited_notices_are_found_and_clean_text_is_not():
    random.seed(2)
    before, after = prose("en", 1, 30), prose("fr", 2, 30)
    for notice in N.NOTICES:
        for _ in range(5):
            chars = list(notice.phrase)
            for _ in range(notice.edits // 2):
                at = random.randrange(2, len(chars) - 2)
                chars[at] = random.choice("xyzw")
            text = f"{before} {''.join(chars)} {after}"
            found = N.scan_text(text.encode())
            assert any(s["edits"] <= notice.edits and s["found"] in " ".join(w.decode() for w in N.normal_words(text.encode())) for s in found[7]), (notice, text)
            assert found[5]
    assert N.scan_text(f"{before} {after}".encode())[1:] == (0, None, None, "", "", 0.0, [])
    gpl = N.scan_text(b"This work is licensed under the GNU General Public License, version 3.")
    assert gpl[5] == "gpl-3" and gpl[6] == 1.0


def test_an_edited_notice_before_a_better_one_is_found():
    same = N.scan_text(b"licensed under tha mit license and licensed under the mit license")
    assert [(x["label"], x["first_word"], x["edits"]) for x in same[7]] == [("mit", 0, 1), ("mit", 6, 0)]
    other = N.scan_text(b"licensed under the gnu gemeral publik license version 2 licensed under the gnu general public license version 3")
    assert [(x["label"], x["edits"]) for x in other[7]] == [("gpl-2", 2), ("gpl-3", 0)] and other[5] == "gpl-2,gpl-3"
