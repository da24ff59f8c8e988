import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
