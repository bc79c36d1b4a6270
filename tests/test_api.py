import importlib

import parquill


def test_all_public_names_exist():
    """Names of functions give way to modules that are loaded under the same name."""
    for name in parquill.__all__:
        home = importlib.import_module(f"parquill.{parquill._HOME[name]}")
        assert hasattr(home, name), name
    assert parquill.prepare_splits is importlib.import_module("parquill.plans.prepare").prepare_splits
