import os

import pytest

RANKS = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def ranks():
    if not os.path.exists(RANKS):
        pytest.skip("no public vocabulary")
    return RANKS
