import pytest

from sparkkv.config import StoreConfig


def test_round_trip_and_errors():
    c = StoreConfig(shards=8, max_memory="2GB", eviction="lru")
    assert StoreConfig.loads(c.dumps()) == c and c.max_bytes == 2 << 30 and StoreConfig.loads("") == StoreConfig()
    for text in ("shards = 3", 'eviction = "mru"', "evict_percent = 101", 'max_memory = "1.5GB"', "other = 1", "max_keys = -1"):
        with pytest.raises(ValueError):
            StoreConfig.loads(text)
