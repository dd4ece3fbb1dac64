"""Sessions of model files, with a cache of optimised graphs."""

from __future__ import annotations

import fcntl
import hashlib
import logging
import os
import platform

LOG = logging.getLogger(__name__)


def processor() -> str:
    """What tells kinds of processors apart, as a graph is optimised for what a processor can do."""
    try:
        with open("/proc/cpuinfo") as f:
            told = sorted({line.strip() for line in f if line.startswith(("flags", "Features", "model name"))})
    except OSError:
        told = [platform.processor()]
    return "\0".join([platform.system(), platform.machine(), *told])


def graph_path(model: str, folder: str, version: str) -> str:
    """Where the optimised graph of a model stands: by the model's bytes, the runtime's version and the processor."""
    with open(model, "rb") as f:
        own = hashlib.file_digest(f, "sha256").hexdigest()
    return os.path.join(folder, hashlib.sha256("\0".join([own, version, processor()]).encode()).hexdigest() + ".onnx")


def open_session(model: str, folder: str | None = None):
    """A session of a model file. folder: of this machine, for optimised graphs. Whoever holds the lock writes a graph,
    under another name first; the others open the model itself meanwhile, as they do if anything fails there."""
    import onnxruntime as ort

    if folder:
        try:
            if (session := _cached(ort, model, folder)) is not None:
                return session
        except Exception as e:  # noqa: BLE001  the cache only saves time
            LOG.warning("no optimised graph of %s: %s", model, e)
    return ort.InferenceSession(model)


def _cached(ort, model: str, folder: str):
    os.makedirs(folder, exist_ok=True)
    path, options = graph_path(model, folder, ort.__version__), ort.SessionOptions()
    if os.path.exists(path):
        options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_DISABLE_ALL
        try:
            return ort.InferenceSession(path, options)
        except Exception as e:  # noqa: BLE001  written anew
            LOG.warning("%s cannot be opened: %s", path, e)
            options = ort.SessionOptions()
    with open(path + ".lock", "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            return None
        draft = f"{path}.{os.getpid()}"
        options.optimized_model_filepath = draft
        try:
            session = ort.InferenceSession(model, options)
            os.replace(draft, path)
        finally:
            if os.path.exists(draft):
                os.remove(draft)
    return session
