"""What tests share."""

from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
#: The smallest tables.
SF = "/root/testdata/sf0.001"
