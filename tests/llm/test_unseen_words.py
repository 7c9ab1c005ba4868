"""New words of a text are judged together, as one by one."""

from collections import Counter

import numpy as np

from loomstone.llm.language import LanguageModel, words_of


def test_new_words_are_softened_together(monkeypatch):
    counts = [(lang, w, 3) for lang, said in (("de", "der die das und nicht"), ("en", "the of and not with"), ("fr", "le la les et pas")) for w in said.split()]
    m, calls = LanguageModel.fit(counts), []
    plain = LanguageModel._softmax
    monkeypatch.setattr(LanguageModel, "_softmax", staticmethod(lambda x: calls.append(len(x)) or plain(x)))
    text = "the notand dert pasles notand " + "x" * 99 + " ωω"
    lang, score = m.predict(text)
    share = np.zeros(3)
    for w, c in Counter(words_of(text)).items():
        if w in m.words:
            share = share + c * plain(m.word_scores[m.words[w]])
            continue
        marked, rows = f"^{w[:64]}$", []
        for i in range(len(marked) - 1):
            known = [g for n in range(4, 0, -1) if i + n <= len(marked) and (g := marked[i : i + n]) in m.grams]
            rows += [m.gram_scores[m.grams[g]] * 0.4 ** (4 - len(g)) for g in known[:1]]
        share = share + c * plain(np.mean(rows, 0) if rows else np.zeros(3))
    assert lang == m.languages[int(np.argmax(share))] and abs(score - share.max() / len(words_of(text))) < 1e-12
    assert len(calls) == 2 and calls[1] == 5  # the known words once a model, the new ones once a text
    assert m.predict(text) == (lang, score) and len(calls) == 2
