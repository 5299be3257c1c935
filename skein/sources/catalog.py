"""Catalogs of systems: which files hold a system's tables and how its ground truth is read."""

from __future__ import annotations

from dataclasses import dataclass

#: Display name, file stem.
SYSTEMS = {
    "A.UML": "argouml", "Ant": "ant", "AS4": "archstudio", "Bash": "bash", "C.Img": "commons", "Hadoop": "hadoop", "HDC": "hdc",
    "HDF": "hdf", "JabRef": "jabref", "LibXML": "libxml", "Lucene": "lucene", "OODT": "oodt", "Pandas": "pandas",
    "SH-3D": "sweetHome", "TeamMates": "teammates", "Chrome": "chromium",
}


@dataclass(frozen=True)
class Preparation:
    """How a system is prepared."""

    folder: str
    language: str
    truth: str
    kind: str
    exclude_tests: bool = False
    collapse: bool = False
    rebuild: bool = False
    add_truth_files: bool = False


#: Raw folder, language, ground-truth file and kind, options.
PREPARATIONS = {
    "ant": Preparation("Ant", "java", "ant_gt.txt", "regex", exclude_tests=True),
    "argouml": Preparation("ArgoUML", "java", "argouml_gt.txt", "regex"),
    "archstudio": Preparation("AS4", "java", "archstudio_gt.json", "json"),
    "bash": Preparation("bash", "c", "bash_gt.json", "json", collapse=True),
    "chromium": Preparation("chromium", "cpp", "chromium_gt.json", "json"),
    "commons": Preparation("Common-Imaging", "java", "CI_gt.txt", "regex", exclude_tests=True),
    "hadoop": Preparation("Hadoop", "java", "hadoop_gt.json", "json", collapse=True),
    "hdc": Preparation("distributed_camera", "c", "hdc_gt.json", "json"),
    "hdf": Preparation("drivers_framework", "c", "hdf_gt.json", "json"),
    "hfd": Preparation("drivers_framework", "c", "hdf_gt.json", "json"),
    "jabref": Preparation("jabref", "java", "jabref_labels.txt", "regex"),
    "libxml": Preparation("libxml", "c", "libxml_gt.json", "json"),
    "lucene": Preparation("Lucene", "java", "lucene_gt.txt", "regex", exclude_tests=True),
    "oodt": Preparation("oodt", "java", "oodt_gt.json", "json", collapse=True),
    "pandas": Preparation("pandas", "python", "pandas_gt.json", "json", rebuild=True, add_truth_files=True),
    "sweetHome": Preparation("SweetHome_3D", "java", "sh_gt.txt", "regex", exclude_tests=True),
    "teammates": Preparation("teammates", "java", "teammates_labels.txt", "regex"),
}


def datasets(common: dict) -> dict[str, tuple[str, str]]:
    """Entity and dependency file of each known system and of those that the configuration adds."""
    out = {name: (f"{stem}.csv", f"{stem}_deps.csv") for name, stem in SYSTEMS.items()}
    for name, files in (common.get("custom_datasets") or {}).items():
        if isinstance(files, dict):
            pair = (files.get("nodes", files.get("node_file")), files.get("dependencies", files.get("dep_file")))
        else:
            pair = tuple(files) if isinstance(files, list | tuple) and len(files) == 2 else (None, None)
        if not all(pair):
            raise ValueError(f"custom dataset {name!r} needs an entity file and a dependency file")
        out[str(name)] = (str(pair[0]), str(pair[1]))
    return out


def select(common: dict, only: list[str] | None = None) -> list[str]:
    """Names to run, in the configured order: included, not excluded; an unknown name raises.

    Names given in ``only`` replace the configured list, so that a known system that the list lacks can be run.
    """
    known = datasets(common)
    names = list(only or common.get("include_datasets") or common.get("datasets") or known)
    dropped = set(common.get("exclude_datasets") or [])
    if wrong := [n for n in [*names, *dropped] if n not in known]:
        raise ValueError(f"unknown datasets: {', '.join(map(str, wrong))}")
    return [n for n in dict.fromkeys(names) if n not in dropped]
