import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return lambda name: str(tokenizers.path(name))
