"""Result sinks: one JSON document a run."""

from __future__ import annotations

import json
import time
from pathlib import Path


def plain(x):
    """Numbers, strings, lists and dicts only."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return x.item() if hasattr(x, "item") else x


def save_result(result: dict, dataset: str, k: int, seed: int, folder: str = "results/label_propagation") -> Path:
    """``{dataset}_k{k}_seed{seed}_{YYYYmmdd_HHMMSS}.json``; the result is a driver-side summary."""
    path = Path(folder) / f"{dataset}_k{k}_seed{seed}_{time.strftime('%Y%m%d_%H%M%S')}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(plain(result), indent=2, ensure_ascii=False))
    return path
