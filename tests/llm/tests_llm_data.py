"""The prose generator of conftest, for modules that need it directly."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
prose, ODD = _module.prose, _module.ODD
