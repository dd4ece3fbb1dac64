import fcntl
import json
import os
import pickle

import numpy as np
import pytest

from orrery.contracts import Contract, EngineError
from orrery.engine import Engine
from orrery.functions import images
from orrery.operators import sessions
from orrery.operators.encode import OnnxEncoder, checked, pixels
from test_engine import png, tree


def field(number, value):
    """A field of a message: numbers as they are, bytes and text with their length."""
    def count(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + count(n >> 7)

    if isinstance(value, int):
        return count(number << 3) + count(value)
    value = value.encode() if isinstance(value, str) else value
    return count(number << 3 | 2) + count(len(value)) + value


def port(name, kind, shape):
    dims = b"".join(field(1, field(1, n) if isinstance(n, int) else field(2, n)) for n in shape)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, dims)))


def node(kind, inputs, output, **ints):
    told = b"".join(field(5, field(1, k) + (b"".join(field(8, x) for x in v) + field(20, 7) if isinstance(v, list) else field(3, v) + field(20, 2))) for k, v in ints.items())
    return field(1, b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, kind) + told)


def model(nodes, given, made):
    return field(1, 8) + field(7, b"".join(nodes) + field(2, "g") + field(11, given) + field(12, made)) + field(8, field(1, "") + field(2, 13))


def vision():
    """Means over the lines of each channel: 3 x 256 numbers."""
    mean = node("ReduceMean", ["x"], "m", axes=[2], keepdims=0)
    return model([mean, node("Flatten", ["m"], "y", axis=1)], port("x", 1, ["n", 3, 256, 256]), port("y", 1, ["n", 768]))


def text():
    """Each token's number as it is."""
    return model([node("Cast", ["x"], "y", to=1)], port("x", 7, [1, 77]), port("y", 1, [1, 77]))


def tokenizer():
    words = {"[PAD]": 0, "[UNK]": 1, "<s>": 2, "</s>": 3, "red": 4, "cat": 5}
    ends = [{"SpecialToken": {"id": k, "type_id": 0}} for k in ("<s>", "</s>")]
    single = [ends[0], {"Sequence": {"id": "A", "type_id": 0}}, ends[1]]
    post = {"type": "TemplateProcessing", "single": single, "pair": single, "special_tokens": {k: {"id": k, "ids": [words[k]], "tokens": [k]} for k in ("<s>", "</s>")}}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"},
                       "post_processor": post, "decoder": None, "model": {"type": "WordLevel", "vocab": words, "unk_token": "[UNK]"}})


@pytest.fixture
def files(tmp_path):
    for name, data in (("v.onnx", vision()), ("t.onnx", text()), ("tok.json", tokenizer().encode())):
        (tmp_path / name).write_bytes(data)
    return [str(tmp_path / n) for n in ("v.onnx", "t.onnx", "tok.json")]


def plain_vector(path):
    """A file's vector by numpy alone."""
    flat = pixels(path).astype(np.float64).mean(1).reshape(-1)
    return flat / np.linalg.norm(flat)


def test_encoder(files, tmp_path):
    rng = np.random.default_rng(3)
    tree(tmp_path / "r", {f"{k}.png": png(rng.integers(0, 256, (30 + k, 40, 3)), filters=(k % 3,)) for k in range(4)})
    paths = [str(tmp_path / f"r/{k}.png").encode() for k in range(4)]
    encoder = pickle.loads(pickle.dumps(OnnxEncoder(*files)))
    prepared = [encoder.prepare(p) for p in paths]
    assert all(p.shape == (3, images.SIDE, images.SIDE) and p.dtype == np.float32 for p in prepared)
    got = checked(encoder.images(prepared), 4)
    assert np.abs(got - np.stack([plain_vector(p) for p in paths])).max() < 1e-5 and list(encoder._open) == [0]
    assert encoder.tokens("red cat dog").tolist() == [[2, 4, 5, 1, 3] + [0] * 72]
    long = encoder.tokens("cat " * 200)[0].tolist()
    assert len(long) == 77 and long[0] == 2 and long[-1] == 3 and set(long[1:-1]) == {5}
    assert encoder.text("red")[:4].tolist() == [2, 4, 3, 0] and list(encoder._open) == [1]  # one model at a time
    with pytest.raises(EngineError, match="shape"):
        checked(encoder.images(prepared)[0], 4)


def test_models_end_to_end(spark, files, tmp_path):
    rng = np.random.default_rng(4)
    shown = {f"{k}.png": rng.integers(0, 256, (30, 40, 3)) for k in range(10)}
    tree(tmp_path / "r", {n: png(x, filters=(0,)) for n, x in shown.items()})
    engine = Engine(spark, str(tmp_path / "r"), OnnxEncoder(*files, graphs=str(tmp_path / "graphs")), Contract("onnx", "v1", 768), str(tmp_path / "i"))
    assert engine.index() == 10
    vectors = {n: plain_vector(str(tmp_path / "r" / n).encode()) for n in shown}
    want = sorted(((float(v @ vectors["3.png"]), n) for n, v in vectors.items() if n != "3.png"), reverse=True)[:4]
    found = engine.search(image=str(tmp_path / "r/3.png"), top=4, threshold=-1.0)
    assert [p.decode() for _, p in found] == [n for _, n in want] and np.abs(np.array([s for s, _ in found]) - [s for s, _ in want]).max() < 1e-4


def test_graph_cache(files, tmp_path, monkeypatch):
    x = np.random.default_rng(5).normal(size=(2, 3, 256, 256)).astype(np.float32)
    run = lambda session: session.run(None, {"x": x})[0]
    folder = str(tmp_path / "graphs")
    want = run(sessions.open_session(files[0]))
    assert (run(sessions.open_session(files[0], folder)) == want).all()
    (kept,) = [n for n in os.listdir(folder) if n.endswith(".onnx")]
    before = os.stat(os.path.join(folder, kept)).st_mtime_ns
    assert (run(sessions.open_session(files[0], folder)) == want).all() and os.stat(os.path.join(folder, kept)).st_mtime_ns == before
    with open(os.path.join(folder, kept), "wb") as f:  # a broken one is written anew
        f.write(b"broken")
    assert (run(sessions.open_session(files[0], folder)) == want).all() and os.path.getsize(os.path.join(folder, kept)) > 20
    os.remove(os.path.join(folder, kept))
    with open(os.path.join(folder, kept + ".lock"), "w") as lock:  # another writes it
        fcntl.flock(lock, fcntl.LOCK_EX)
        assert (run(sessions.open_session(files[0], folder)) == want).all() and kept not in os.listdir(folder)
    own = sessions.graph_path(files[0], folder, "1")
    assert own != sessions.graph_path(files[1], folder, "1") and own != sessions.graph_path(files[0], folder, "2")
    monkeypatch.setattr(sessions, "processor", lambda: "another")
    assert own != sessions.graph_path(files[0], folder, "1")
    (tmp_path / "file").write_text("")
    assert (run(sessions.open_session(files[0], str(tmp_path / "file"))) == want).all()  # no folder, no cache
    with pytest.raises(Exception):
        sessions.open_session(files[2], folder)
