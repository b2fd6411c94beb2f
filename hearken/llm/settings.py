"""Values that the registered queries and the pipeline share."""

from __future__ import annotations

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: A caller's secret in production; fixed here so that results can be compared.
PSEUDONYM_KEY = "example key"
