"""The catalog of file-type rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20

# Magic, extension, category, greatest size in MiB, base confidence, footer, footer window in MiB, validator.
# The place of a line is the rule's number; it decides ties, so lines must keep their order.
RULES = """
FFD8FF jpg Image 30 0.90 FFD9 30 jpeg
89504E470D0A1A0A png Image 50 0.95 49454E44AE426082 50 png
474946383761 gif Image 10 0.92 003B 10 -
474946383961 gif Image 10 0.92 003B 10 -
424D bmp Image 100 0.80 - - bmp
49492A00 tif Image 200 0.88 - - -
4D4D002A tif Image 200 0.88 - - -
38425053 psd Image 500 0.95 - - -
00000100 ico Image 10 0.80 - - -
49492A00100000004352 cr2 Image 200 0.96 - - -
3C737667 svg Image 20 0.85 3C2F7376673E 20 -
52494646 webp Image 50 0.85 - - -
255044462D pdf Document 500 0.95 2525454F46 1 pdf
504B0304 zip Archive 4096 0.90 504B0506 2 zip
D0CF11E0A1B11AE1 doc Document 100 0.88 - - -
7B5C72746631 rtf Document 50 0.90 7D 50 -
252150532D41646F62652D ps Document 100 0.90 - - -
3C3F786D6C20 xml Document 50 0.85 - - -
3C21444F43545950452068746D6C html Document 30 0.85 - - -
3C68746D6C html Document 30 0.80 - - -
7B22 json Document 50 0.75 - - json
526172211A0700 rar Archive 4096 0.95 - - -
526172211A070100 rar Archive 4096 0.95 - - -
377ABCAF271C 7z Archive 4096 0.97 - - -
1F8B08 gz Archive 4096 0.92 - - -
425A68 bz2 Archive 4096 0.90 - - -
FD377A585A00 xz Archive 4096 0.96 - - -
4D534346 cab Archive 500 0.92 - - -
636F6E6563746978 vhd Archive 4096 0.95 - - -
4B444D56 vmdk Archive 4096 0.95 - - -
494433 mp3 Audio 200 0.85 - - -
FFFB mp3 Audio 200 0.70 - - mp3
52494646 wav Audio 500 0.75 - - wav
4F676753 ogg Audio 500 0.95 - - -
664C6143 flac Audio 500 0.97 - - -
4D546864 mid Audio 20 0.95 - - -
FFF1 aac Audio 200 0.80 - - aac
FFF9 aac Audio 200 0.80 - - aac
3026B2758E66CF11 wma Audio 2000 0.95 - - -
00000018667479706D7034 mp4 Video 4096 0.90 - - mp4
0000002066747970 mp4 Video 4096 0.85 - - mp4
000000146674797071742020 mov Video 4096 0.92 - - -
000000206674797071742020 mov Video 4096 0.90 - - -
0000001866747970336770 3gp Video 500 0.90 - - -
1A45DFA3 mkv Video 4096 0.90 - - -
464C5601 flv Video 2000 0.92 - - -
7F454C46 elf Executable 500 0.97 - - elf
4D5A exe Executable 500 0.80 - - pe
CAFEBABE macho Executable 500 0.95 - - -
CFFAEDFE macho Executable 500 0.95 - - -
0061736D wasm Executable 100 0.95 - - -
6465780A30333500 dex Executable 100 0.98 - - -
53514C69746520666F726D6174203300 sqlite Database 4096 0.99 - - -
72656766 dat Database 500 0.95 - - -
456C6646696C6500 evtx Database 500 0.98 - - -
D4C3B2A1 pcap Database 2000 0.95 - - -
A1B2C3D4 pcap Database 2000 0.95 - - -
0A0D0D0A pcapng Database 2000 0.95 - - -
2D2D2D2D2D424547494E20 pem Certificate 1 0.85 2D2D2D2D2D454E4420 1 pem
414B4941 key Certificate 1 0.92 - - aws_key
6768705F token Certificate 1 0.95 - - github_pat
65794A jwt Certificate 1 0.90 - - jwt
7B2263727970746F223A7B22 json Certificate 1 0.95 - - eth_keystore
2D2D2D2D2D424547494E2050475020 asc Certificate 2 0.90 - - -
03D9A29A67FB4BB5 kdbx Certificate 100 0.99 - - -
03D9A29A65FB4BB5 kdb Certificate 100 0.99 - - -
00053162 wallet Certificate 100 0.95 - - -
000000186674797063727820 cr3 Image 250 0.96 - - -
46554A4946494C4D4343442D52415720 raf Image 200 0.97 - - -
4949524F08000000 orf Image 200 0.96 - - -
4949550008000000 rw2 Image 200 0.96 - - -
49492A0008000000 arw Image 250 0.95 - - -
44445320 dds Image 100 0.90 - - -
762F3101 exr Image 500 0.95 - - -
384250530002 psb Image 2048 0.95 - - -
C5D0D3C6 eps Image 100 0.92 - - -
000000186674797068656963 heic Image 100 0.95 - - -
00000018667479706D696631 heif Image 100 0.95 - - -
0000001C6674797061766966 avif Image 100 0.95 - - -
0000000C4A584C200D0A870A jxl Image 100 0.97 - - -
414331303135 dwg Document 500 0.96 - - -
414331303138 dwg Document 500 0.96 - - -
414331303231 dwg Document 500 0.96 - - -
414331303234 dwg Document 500 0.96 - - -
414331303237 dwg Document 500 0.96 - - -
414331303332 dwg Document 500 0.96 - - -
424C454E444552 blend Document 2000 0.98 - - -
676C5446 glb Document 1000 0.95 - - -
4B617964617261204642582042696E6172792020001A00 fbx Document 1000 0.99 - - -
4954534603000000 chm Document 200 0.95 - - -
FF575043 wpd Document 100 0.90 - - -
0606EDF5D81D46E5BD31EFE7FE74B71D indd Document 1000 0.99 - - -
00000020667479704D344120 m4a Audio 500 0.92 - - -
4D414320 ape Audio 500 0.95 - - -
4D50434B mpc Audio 200 0.95 - - -
0B77 ac3 Audio 500 0.75 - - -
437265617469766520566F6963652046696C65 voc Audio 100 0.98 - - -
457874656E646564204D6F64756C653A20 xm Audio 30 0.98 - - -
000001BA mpg Video 4096 0.85 - - -
47400010 ts Video 4096 0.85 - - -
060E2B3402050101 mxf Video 4096 0.95 - - -
2E524D46000000 rm Video 2000 0.95 - - -
42494B69 bik Video 2000 0.96 - - -
28B52FFD zst Archive 4096 0.95 - - -
04224D18 lz4 Archive 4096 0.95 - - -
2D6C68352D lzh Archive 500 0.92 - - -
60EA arj Archive 500 0.90 - - -
3C3C3C204F7261636C6520564D205669727475616C426F78204469736B20496D616765203E3E3E vdi Archive 4096 0.99 - - -
7668647866696C65 vhdx Archive 4096 0.99 - - -
514649FB qcow2 Archive 4096 0.98 - - -
68737173 squashfs Archive 4096 0.95 - - -
53EF ext4 Archive 4096 0.85 - - -
4D5357494D000000 wim Archive 4096 0.98 - - -
550D0D0A pyc Executable 50 0.95 - - -
610D0D0A pyc Executable 50 0.95 - - -
6F0D0D0A pyc Executable 50 0.95 - - -
A70D0D0A pyc Executable 50 0.95 - - -
CB0D0D0A pyc Executable 50 0.95 - - -
1B4C7561 luac Executable 50 0.96 - - -
02000C00 arsc Executable 100 0.95 - - -
EDABEEDB rpm Executable 2000 0.98 - - -
4D414D04 pf Database 20 0.98 - - -
53434341 pf Database 20 0.98 - - -
4D444D5093A7 dmp Database 500 0.99 - - -
454D694C lime Database 4096 0.98 - - -
2D4656452D46532D fve Certificate 10 0.99 - - -
EFCDAB89 edb Database 4096 0.95 - - -
4C00000001140200 lnk Database 10 0.98 - - -
5B496E746572666163655D conf Certificate 1 0.90 - - -
2D2D2D2D2D424547494E204F50454E5353482050524956415445204B45592D2D2D2D2D key Certificate 1 0.99 - - -
01110101 keys Certificate 10 0.95 - - -
7B0A20202274797065223A2022736572766963655F6163636F756E7422 json Certificate 1 0.98 - - -
736B5F6C6976655F key Certificate 1 0.95 - - -
786F78622D token Certificate 1 0.95 - - -
"""
# Fixed value: footer window where a rule names none.
DEFAULT_WINDOW = 512 * 1024
# Icon names of the categories.
CATEGORIES = ("Image", "Document", "Archive", "Audio", "Video", "Executable", "Database", "Certificate", "Other")


@dataclass(frozen=True)
class Rule:
    number: int
    magic: bytes
    extension: str
    category: str
    max_size: int
    confidence: float
    footer: bytes | None
    footer_window: int
    validator: str | None


def _parse(number: int, line: str) -> Rule:
    magic, ext, category, most, confidence, footer, window, validator = line.split()
    return Rule(
        number, bytes.fromhex(magic), ext, category, int(most) * MIB, float(confidence), None if footer == "-" else bytes.fromhex(footer),
        DEFAULT_WINDOW if window == "-" else int(window) * MIB, None if validator == "-" else validator,
    )


def rules(extensions: list[str] | None = None) -> list[Rule]:
    """All rules, or those of the extensions; an empty list means all."""
    every = [_parse(i, line) for i, line in enumerate(RULES.split("\n")[1:-1])]
    return [r for r in every if not extensions or r.extension in extensions]


def rules_frame(spark: SparkSession, extensions: list[str] | None = None) -> DataFrame:
    """The rules as a table of bounded size; joins may send it to all tasks."""
    data = [(r.number, r.magic, r.extension, f"{r.extension} ({r.category})", r.max_size, r.confidence, r.footer, r.footer_window, r.category, r.validator) for r in rules(extensions)]
    schema = "sig_idx int, magic binary, extension string, description string, max_size long, confidence_base float, footer binary, footer_window long, category string, validator string"
    return spark.createDataFrame(data, schema)


def catalog_stats(frame: DataFrame) -> DataFrame:
    """Rules and extensions of each category."""
    return frame.groupBy("category").agg(F.count("*").alias("n_rules"), F.countDistinct("extension").alias("n_extensions"))


def catalog_search(frame: DataFrame, query: str) -> DataFrame:
    """Rules that hold the query in extension, description, category or magic (as hex), case aside."""
    fields = F.concat_ws("\n", "extension", "description", "category", F.hex("magic"))
    return frame.where(F.contains(F.lower(fields), F.lit(query.lower())))
