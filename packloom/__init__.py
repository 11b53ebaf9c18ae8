"""Asset and chunk analytics over Spark DataFrames."""

from .plans.analyze import analyze, report
from .plans.package import build, build_incremental, extract_all, extract_file, open_package, sign, verify, verify_signature
from .plans.patch import apply_patch, build_patch
from .sources.assets import documents_as_assets, scan_assets
from .sources.config import Settings, load

__all__ = ["Settings", "analyze", "apply_patch", "build", "build_incremental", "build_patch", "documents_as_assets", "extract_all", "extract_file", "load", "open_package", "report", "scan_assets", "sign", "verify", "verify_signature"]
