"""Plain versions that tests share."""

import zlib

import numpy as np

from citeweave.llm.queries import tokenizer_path


def plain_tokens(rows):
    """(id, start, n_tokens, crc) of (id, text) rows, by the library alone."""
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out)
