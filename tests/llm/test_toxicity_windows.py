"""A phrase scores alike wherever it stands among neutral words."""

import numpy as np
import pytest

from mergelens.llm import toxicity


def model_of(**values):
    toxic = np.zeros(1 << toxicity.BITS)
    for w, x in values.items():
        toxic[toxicity.subwords([w.encode()])[0]] = x
    return toxicity.Model(toxic, -3.0, 1.0, 0.0)


@pytest.mark.parametrize("part", [16_000, 16])
def test_windows_begin_at_every_word(monkeypatch, part):
    monkeypatch.setattr(toxicity, "PART", part)
    model = model_of(zzaqq=1.0, vvyuu=0.5)
    texts = ["k " * i + "zzaqq vvyuu zzaqq vvyuu " + "k " * (60 - i) for i in range(60)]
    got = toxicity._top(model, texts)
    assert np.ptp(got) < 1e-9 and abs(got[0]) < 1e-9  # 1 + 0.5 + 1 + 0.5 - 3
    for text in [*texts, "zzaqq", "k zzaqq", "k k k k k k k vvyuu", "zzaqq k k k k k k k vvyuu", "vvyuu " * 9]:
        ws = toxicity.words(text)
        value = [{b"zzaqq": 1.0, b"vvyuu": 0.5}.get(w, 0.0) for w in ws]
        size = min(8, len(ws))
        tail = len(ws) % 8
        short = [sum(value[-tail:]) * 8 / tail] if tail and len(ws) > 8 else []
        want = max([sum(value[i : i + size]) * 8 / size for i in range(len(ws) - size + 1)] + short) - 3
        assert abs(toxicity._top(model, [text, "k k", text])[2] - want) < 1e-9
    assert list(toxicity._top(model, [None, "", " "])) == [-3.0] * 3
