"""Relations of the engine.

``files`` has a row for each source file, ``imports`` one for each import
specification (a bag). Violations carry where they come from and, unless the
source alone is at fault, what they lead to.
"""

from __future__ import annotations

FILES = "path string, package_path string, package string, package_line int"
IMPORTS = "path string, ordinal int, import_path string, resolved_path string, dependency_type string, line int"
SOURCE = "struct<path:string,line:int,package_name:string>"
TARGET = "struct<path:string,import_path:string,type:string>"
VIOLATIONS = f"rule string, comment string, severity string, kind string, from {SOURCE}, to {TARGET}"
BASELINE = "rule string, from string, to string"

STDLIB, LOCAL, MODULE, UNRESOLVED = "stdlib", "local", "module", "unresolved"
