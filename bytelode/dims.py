"""Fixed values that results depend on: signatures, types, partition names, base confidences."""

from __future__ import annotations

#: Fixed values. File type: (label, extension), in natural order.
TYPES = {
    "jpeg": ("JPEG Image", "jpg"), "png": ("PNG Image", "png"), "gif": ("GIF Image", "gif"), "bmp": ("BMP Image", "bmp"),
    "tiff": ("TIFF Image", "tiff"), "ico": ("ICO Icon", "ico"), "psd": ("PSD Image", "psd"), "pdf": ("PDF Document", "pdf"),
    "mp4": ("MP4 Video", "mp4"), "webp": ("WebP Image", "webp"), "wav": ("WAV Audio", "wav"), "avi": ("AVI Video", "avi"),
    "mp3": ("MP3 Audio", "mp3"), "flac": ("FLAC Audio", "flac"), "ogg": ("OGG Audio", "ogg"), "zip": ("ZIP Archive", "zip"),
    "rar": ("RAR Archive", "rar"), "7z": ("7z Archive", "7z"), "tar": ("TAR Archive", "tar"), "exe": ("PE Executable", "exe"),
    "elf": ("ELF Binary", "elf"), "wasm": ("WebAssembly", "wasm"), "sqlite": ("SQLite Database", "sqlite"), "xml": ("XML Document", "xml"),
    "html": ("HTML Document", "html"), "unknown": ("Unknown Binary", "bin"),
}
ARCHIVES = ("zip", "rar", "7z", "tar")
#: Fixed values. Signatures (hex, type) in the order that identification tries them.
SIGNATURES = [
    ("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("47494638", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"),
    ("00000100", "ico"), ("38425053", "psd"), ("25504446", "pdf"), ("66747970", "mp4"), ("57454250", "webp"), ("57415645", "wav"),
    ("41564920", "avi"), ("FFFB", "mp3"), ("FFFA", "mp3"), ("494433", "mp3"), ("664C6143", "flac"), ("4F676753", "ogg"),
    ("504B0304", "zip"), ("526172211A07", "rar"), ("377ABCAF271C", "7z"), ("7573746172", "tar"), ("4D5A9000", "exe"), ("7F454C46", "elf"),
    ("0061736D", "wasm"), ("53514C697465", "sqlite"), ("3C3F786D6C", "xml"), ("3C21444F43", "html"), ("3C68746D6C", "html"),
]
#: Fixed values. How far before the signature a file of the type begins.
BACK_UP = {"mp4": 4, "webp": 8, "wav": 8, "avi": 8, "tar": 257}
#: Fixed values. Input containers by prefix.
CONTAINERS = [("504B0304", "zip"), ("377ABCAF271C", "7z"), ("52617221", "rar"), ("1F8B", "gzip"), ("425A68", "bzip2"), ("FD377A585A", "xz")]
#: Fixed values. MBR partition type byte: name.
MBR_NAMES = {
    0x01: "FAT12", 0x04: "FAT16", 0x06: "FAT16", 0x0E: "FAT16", 0x0B: "FAT32", 0x0C: "FAT32", 0x07: "NTFS/exFAT", 0x05: "Extended", 0x0F: "Extended",
    0x82: "Linux swap", 0x83: "Linux", 0x8E: "Linux LVM", 0xA5: "FreeBSD", 0xAF: "HFS+", 0xEE: "GPT Protective", 0xEF: "EFI System", 0xFD: "Linux RAID",
}
#: Fixed values. Confidence before validation.
CONFIDENCE = {"zip": 0.95, "tar": 0.90, "blob": 0.85, "carved_trimmed": 0.70, "carved": 0.55, "plugin_ended": 0.65, "plugin": 0.50, "rar5": 0.60, "rar4": 0.55}
#: Fixed values. Limits.
DEDUP_GAP, LEAST_FILE, MOST_OUTPUT = 4, 32, 512 << 20
ENTROPY_LOW, ENTROPY_HIGH = 1.5, 7.85
