"""Token ids of whole texts, word by word, with the tokenizers library inside tasks."""

from __future__ import annotations

import os
from collections.abc import Callable

from labelscope.llm.scratch import worker_store

MEMO = 800_000  # remembered pieces per worker; the memory is emptied when it is full
LONGEST = 48    # longer pieces are encoded each time


def load(path: str):
    """The tokenizer of a ``.json`` file, once per Python worker, on one thread."""
    store = worker_store()
    if ("tokenizer", path) not in store:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        store["tokenizer", path] = tokenizer
    return store["tokenizer", path]


def remembered(name: tuple, pieces_of: list[list[str]], encode: Callable[[list[str]], list]) -> dict:
    """``encode`` of every piece, as a dictionary kept between batches and tasks.
    Pieces over LONGEST characters are kept for this call only."""
    store = worker_store()
    memo = store.setdefault(name, {})
    missing = {p for pieces in pieces_of for p in pieces if p not in memo}
    if not missing:
        return memo
    if len(memo) + len(missing) > MEMO:
        memo = store[name] = {}
        missing = {p for pieces in pieces_of for p in pieces}
    long = [p for p in missing if len(p) > LONGEST]
    short = [p for p in missing if len(p) <= LONGEST] if long else list(missing)
    for s in range(0, len(short), 4096):
        part = short[s:s + 4096]
        memo.update(zip(part, encode(part)))
    return {**memo, **dict(zip(long, encode(long)))} if long else memo
