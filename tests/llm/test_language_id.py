"""Training sees every window of a long word, as prediction does."""

import numpy as np

from rulecast.llm import language_id


def test_later_windows_are_trained():
    net, seen = language_id.ByteGru(2, 1), set()
    learn = net.gradients
    net.gradients = lambda codes, labels: (seen.update(bytes(c[c != language_id._PAD].astype(np.uint8)) for c in codes.T), learn(codes, labels))[1]
    words = [bytes([65 + k] * language_id.WINDOW + [97 + k] * language_id.WINDOW + [48 + k]) for k in range(2)]
    net.fit(words, np.array([0, 1]), steps=3)
    assert {bytes([97] * language_id.WINDOW), b"0", b"1"} <= seen
