"""The parameters of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass, field

# Commands, and groups of which one may be given.
COMMANDS = ["copy", "move", "link", "extract", "zip", "playlist", "test", "dir2dat", "fixdat", "clean", "report"]
EXCLUSIVE = [{"copy", "move", "link"}, {"link", "extract", "zip"}, {"dir2dat", "fixdat"}]
WRITERS = {"copy", "move", "link"}
ONLY_FLAGS = ["bios", "device", "unlicensed", "debug", "demo", "beta", "sample", "prototype", "program", "aftermarket", "homebrew", "unverified", "bad"]


@dataclass(frozen=True)
class Options:
    """What to read, filter, prefer and write; checked when it is made."""

    commands: frozenset[str] = frozenset()
    # inputs
    input: tuple[str, ...] = ()
    input_exclude: tuple[str, ...] = ()
    input_checksum_quick: bool = False
    input_checksum_min: str = "crc32"
    input_checksum_max: str = "sha1"
    input_checksum_archives: str = "auto"
    dat: tuple[str, ...] = ()
    dat_exclude: tuple[str, ...] = ()
    dat_name_regex: str | None = None
    dat_name_regex_exclude: str | None = None
    dat_description_regex: str | None = None
    dat_description_regex_exclude: str | None = None
    dat_combine: bool = False
    dat_ignore_parent_clone: bool = False
    patch: tuple[str, ...] = ()
    patch_exclude: tuple[str, ...] = ()
    patch_only: bool = False
    # output paths
    output: str | None = None
    dir_mirror: bool = False
    dir_dat_mirror: bool = False
    dir_dat_name: bool = False
    dir_dat_description: bool = False
    dir_letter: bool = False
    dir_letter_count: int = 1
    dir_letter_limit: int | None = None
    dir_letter_group: bool = False
    dir_game_subdir: str = "multiple"
    output_console_tokens: str | None = None
    # writing
    fix_extension: str = "auto"
    overwrite: bool = False
    overwrite_invalid: bool = False
    write_retry: int = 2
    move_delete_dirs: str = "auto"
    clean_exclude: tuple[str, ...] = ()
    clean_backup: str | None = None
    clean_dry_run: bool = False
    zip_format: str = "torrentzip"
    zip_exclude: str | None = None
    zip_dat_name: bool = False
    link_mode: str = "hardlink"
    symlink_relative: bool = False
    # headers and padding
    header: str | None = None
    remove_headers: tuple[str, ...] | None = None
    trimmed_glob: str | None = None
    trim_scan_files: str = "auto"
    trim_scan_archives: bool = False
    trim_add_padding: bool = False
    # sets
    merge_roms: str = "fullnonmerged"
    merge_discs: bool = False
    exclude_disks: bool = False
    allow_excess_sets: bool = False
    allow_incomplete_sets: bool = False
    # filters
    filter_regex: str | None = None
    filter_regex_exclude: str | None = None
    filter_language: tuple[str, ...] = ()
    filter_region: tuple[str, ...] = ()
    filter_category_regex: str | None = None
    no: frozenset[str] = frozenset()
    only: frozenset[str] = frozenset()
    only_retail: bool = False
    # preferences
    single: bool = False
    prefer_game_regex: str | None = None
    prefer_rom_regex: str | None = None
    prefer_verified: bool = False
    prefer_good: bool = False
    prefer_language: tuple[str, ...] = ()
    prefer_region: tuple[str, ...] = ()
    prefer_revision: str | None = None
    prefer_retail: bool = False
    prefer_parent: bool = False
    prefer_filetype: str | None = None
    prefer_filename_regex: str | None = None
    # other sinks
    playlist_mode: str = "multiple"
    playlist_extensions: tuple[str, ...] = (".cue", ".gdi", ".mdf", ".chd")
    dir2dat_output: str | None = None
    fixdat_output: str | None = None
    report_output: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for c in self.commands - set(COMMANDS):
            raise ValueError(f"no such command: {c}")
        for group in EXCLUSIVE:
            if len(self.commands & group) > 1:
                raise ValueError(f"only one of {', '.join(sorted(group))} can be given")
        if self.commands & {"extract", "zip"} and not self.commands & {"copy", "move"}:
            raise ValueError("extract and zip need copy or move")
        if "clean" in self.commands and not self.writes:
            raise ValueError("clean needs copy, move or link")
        if bad := (self.no | self.only) - set(ONLY_FLAGS):
            raise ValueError(f"no such flag: {', '.join(sorted(bad))}")
        if self.single and not self.dat and not self.input:
            raise ValueError("single needs a catalog")

    @property
    def writes(self) -> bool:
        return bool(self.commands & WRITERS)
