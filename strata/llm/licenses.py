"""Licence labels by template markup compiled into word automata.

A template is words, [optional words] and {n}: up to n replaceable words. It
accepts a stretch of text that has all mandatory words in order and nothing
else outside optional and replaceable regions. The score is 1 where a label was
found, else the largest share of a template's mandatory words that some stretch
has in order from its beginning. Null, empty and wordless texts have no words,
no labels and score 0; repeated rows are each judged alone; an empty table gives
an empty result; other columns are not read and may have any names.
"""

import re

from pyspark.sql import DataFrame

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices of the GNU family, and the whole wording of short licences.
GNU = "under [the terms of] the gnu {name} [as published by the free software foundation] [either] version {version}"
MPL = "this source code form is subject to the terms of the mozilla public license v 2 0"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
MIT = """permission is hereby granted free of charge to any person obtaining a copy of {4} and associated documentation files [the software]
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall {10} be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution
[3] [neither the name of {12} nor the names of {4} contributors may be used to endorse or promote products derived from this software without specific prior written permission]
this software is provided by {10} as is and any express or implied warranties including but not limited to the implied warranties of merchantability
and fitness for a particular purpose are disclaimed in no event shall {10} be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused
and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage"""
GENERAL = "general public license"
TEMPLATES = [
    *[(GNU.format(name=GENERAL, version=v), f"gpl-{v}") for v in (2, 3)],
    (GNU.format(name=f"affero {GENERAL}", version=3), "agpl-3"),
    (GNU.format(name=f"lesser {GENERAL}", version=3), "lgpl-3"),
    (GNU.format(name=f"lesser {GENERAL}", version="2 1"), "lgpl-2.1"),
    (MPL, "mpl-2"),
    (ISC, "isc"),
    (MIT, "mit"),
    (BSD, "bsd"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def compile_template(text: str) -> tuple[list[str | None], dict[int, set[int]], list[int]]:
    """The word each state reads (None: any word), the states it may skip to and the mandatory words before it."""
    reads, skips, need = [], {}, [0]

    def read(part, must):
        for x in re.findall(r"\{\d+\}|[^\s{}]+", part):
            for _ in range(int(x[1:-1]) if x[0] == "{" else 1):
                if x[0] == "{":
                    skips.setdefault(len(reads), set()).add(len(reads) + 1)
                reads.append(None if x[0] == "{" else x)
                need.append(need[-1] + (must and x[0] != "{"))

    for part in re.findall(r"\[[^\]]*\]|[^\[\]]+", text):
        begin = len(reads)
        read(part.strip("[]"), part[0] != "[")
        if part[0] == "[" and len(reads) > begin:
            skips.setdefault(begin, set()).add(len(reads))
    if not reads or reads[0] is None or 0 in skips:
        raise ValueError("a template begins with a mandatory word")
    return reads, skips, need


def covered(automaton, words: list[str], at: int) -> float:
    """The share of the mandatory words that the text has in order from `at` on; 1 where the template accepts."""
    reads, skips, need = automaton
    states, most = {0}, 0
    for i in range(at, len(words) + 1):
        todo = list(states)
        while todo:
            for x in skips.get(todo.pop(), ()):
                if x not in states:
                    states.add(x)
                    todo.append(x)
        most = max([most, *(need[s] for s in states)])
        if most == need[-1] or i == len(words):
            break
        states = {s + 1 for s in states if reads[s] in (words[i], None)}
        if not states:
            break
    return most / need[-1]


def accepts(automaton, words: list[str], at: int) -> bool:
    return covered(automaton, words, at) == 1


def licenses(docs: DataFrame, templates=tuple(TEMPLATES)) -> DataFrame:
    own = [(compile_template(t), label, base) for group, base in ((BASE.items(), True), (templates, False)) for t, label in group]
    by_first: dict[str, list] = {}
    for x in own:
        by_first.setdefault(x[0][0][0], []).append(x)

    def judge(doc_id, text):
        words = WORD.findall(text.translate(LOWER)) if isinstance(text, str) else []
        places, base, more, score = [], set(), set(), 0.0
        for i, w in enumerate(words):
            for automaton, label, is_base in by_first.get(w, ()):
                share = covered(automaton, words, i)
                if share == 1:
                    (base if is_base else more).add(label)
                    places += [i] * is_base
                if share == 1 or not is_base:
                    score = max(score, share)
        return doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [judge(*r) for r in zip(b["doc_id"].to_pylist(), b["text"].to_pylist())]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
