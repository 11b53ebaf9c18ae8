"""Asset types, roles and the choices that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .paths import extension

TYPES = ["Texture", "Mesh", "Audio", "Unknown"]

# Fixed values of the asset formats: file signatures and extensions.
TEXTURE_MAGIC = ["89504E470D0A1A0A", "FFD8FF", "44445320", "AB4B5458203230BB0D0A1A0A", "AB4B5458203131BB0D0A1A0A"]
MESH_MAGIC = ["676C5446"]
AUDIO_MAGIC = ["4F676753", "664C6143"]
RIFF_MAGIC, WAVE_MAGIC, ID3_MAGIC = "52494646", "57415645", "494433"
TEXTURE_EXT = ["png", "jpg", "jpeg", "tga", "dds", "ktx", "ktx2", "hdr", "exr"]
MESH_EXT = ["fbx", "obj", "gltf", "glb", "mesh", "dae", "blend"]
AUDIO_EXT = ["wav", "ogg", "mp3", "flac", "aac", "m4a", "opus"]
COMPRESSED_TEXTURE_EXT = ["dds", "ktx", "ktx2", "jpg", "jpeg", "png"]
COMPRESSED_AUDIO_EXT = ["ogg", "mp3", "flac", "aac", "m4a", "opus"]
ROLE_WORDS = {"Normal": ["normal", "nrm"], "Roughness": ["rough", "rgh"], "Metallic": ["metal", "spec"], "Albedo": ["albedo", "diffuse", "basecolor"]}
LEVELS = {"Texture": 9, "Audio": 1}
DEFAULT_LEVEL = 3


def magic(content: Column) -> Column:
    """The first 16 bytes, filled up with zeros."""
    return F.rpad(F.substring(content, 1, 16), 16, F.lit(bytes(1)))


def type_by_magic(content: Column) -> Column:
    """Type by signature, null where none fits; the first rule that fits decides."""
    head = F.hex(magic(content))
    begins = lambda h: F.startswith(head, F.lit(h))
    any_of = lambda hs: F.rlike(head, F.lit("^(" + "|".join(hs) + ")"))
    wave = begins(RIFF_MAGIC) & (F.substring(head, 17, 8) == WAVE_MAGIC)
    mpeg = begins(ID3_MAGIC) | F.rlike(head, F.lit("^FF[EF]"))
    return F.when(any_of(TEXTURE_MAGIC), "Texture").when(any_of(MESH_MAGIC), "Mesh").when(any_of(AUDIO_MAGIC) | wave | mpeg, "Audio")


def type_by_extension(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(TEXTURE_EXT), "Texture").when(ext.isin(MESH_EXT), "Mesh").when(ext.isin(AUDIO_EXT), "Audio").otherwise("Unknown")


def asset_type(path: Column, content: Column) -> Column:
    return F.coalesce(type_by_magic(content), type_by_extension(path))


def texture_role(path: Column) -> Column:
    """Role by words anywhere in the path; the first role in order wins."""
    name, out = F.lower(path), None
    for role, words in ROLE_WORDS.items():
        hit = F.rlike(name, F.lit("|".join(words)))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("Unknown")


def asset_class(kind: Column, path: Column) -> Column:
    return F.when(kind == "Texture", F.concat(F.lit("texture/"), texture_role(path))).otherwise(F.lower(kind))


def stored_raw(kind: Column, path: Column) -> Column:
    """Formats that are compressed already and are stored as they are."""
    ext = extension(path)
    return ((kind == "Texture") & ext.isin(COMPRESSED_TEXTURE_EXT)) | ((kind == "Audio") & ext.isin(COMPRESSED_AUDIO_EXT))


def codec_level(kind: Column, levels: dict[str, int] | None = None, default: int = DEFAULT_LEVEL) -> Column:
    out = F.lit(default)
    for name, level in (LEVELS | (levels or {})).items():
        out = F.when(kind == name, level).otherwise(out)
    return out


def pre_encoding(kind: Column, mesh_delta: bool = True) -> Column:
    return F.when((kind == "Mesh") & F.lit(mesh_delta), "DeltaBytes").otherwise("None")


def dict_class(kind: Column) -> Column:
    """Whose compression dictionary a type uses."""
    return F.when(kind.isin("Texture", "Mesh"), F.lower(kind)).otherwise("other")
