"""Recall and precision on text that the models haven't seen: whole templates of the seeds are held out of the fit."""

import re
import zlib

from loomline.llm import residue as R
from loomline.llm import residue_seeds as S


def _template(text):
    """What texts of one template share: fields, codes and names apart."""
    return re.sub(r"[0-9]+|[a-z]+[_-][a-z_-]+", "0", text.lower())[:60]


def _split(texts, fold):
    """Texts of four templates in five, and of the fifth."""
    seen, rest = [], []
    for t in texts:
        (rest if zlib.crc32(_template(t).encode()) % 5 == fold else seen).append(t)
    return seen, rest


def _share(models, texts):
    found = [R.coverage(models, [u.text for u in R.units(t)]).max(initial=0) >= R.COVERAGE for t in texts]
    return sum(found) / len(found)


def test_held_out_templates():
    for fold in (0, 3):
        parts = [_split(list(dict.fromkeys(x)), fold) for x in (S.stand_ins(), S.notices(), S.prose())]
        models = R.Models.fit([p[0] for p in parts])
        forms, notices, prose = ([t for t in p[1] if len(t) > 6] for p in parts)
        recall = [_share(models, x) for x in (forms, notices)]
        wrong = _share(models, [p for p in prose if len(p) > 12][::4])
        print(fold, recall, wrong)
        assert min(recall) >= 0.9 and wrong <= 0.03


def test_header_words_in_a_message():
    """Lines that look like those of a header are read where no header stands, and left alone in one."""
    models = R.fit()
    found = lambda text: any(c >= R.COVERAGE for c in R.coverage(models, [u.text for u in R.units(text)]).max(axis=1, initial=0))
    for line in ("branch: {{ branch }}", "tag: lorem ipsum dolor sit amet consectetur", "files: please enable JavaScript to continue", "parent: TODO: your summary here", "Index: lorem ipsum dolor sit amet"):
        assert found(f"Fix the parser of totals\n\n{line}\n"), line
    header = "changeset:   12:0a1b2c3d4e5f\nbranch:      default\ntag:         tip\nparent:      11:0a1b2c3d4e5f\nuser:        Ada Byron <ada@mail.example>\ndate:        2024-01-01 10:00 +0000\nfiles:       a.txt b.txt\ndescription:\nFix the parser of totals\n"
    assert [u.text for u in R.units(header)] == ["Ada Byron <ada@mail.example>", "Fix the parser of totals"] and not found(header)
