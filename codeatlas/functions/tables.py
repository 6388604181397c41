"""Language, category, role and level-of-detail tables. They must be these for
right results; everything else derives from them."""

from __future__ import annotations

# -- fixed values ---------------------------------------------------------------------------
MAKE_NAMES = ["Makefile", "makefile", "GNUmakefile"]
LANGUAGES = {
    "rust": "rs", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh", "python": "py", "javascript": "js jsx", "typescript": "ts", "tsx": "tsx",
    "csharp": "cs", "markdown": "md markdown", "toml": "toml", "make": "mk", "glsl": "glsl vert frag geom comp tesc tese rgen rchit", "hlsl": "hlsl fx fxh",
}
RETAINED_TEXT = "md markdown txt toml json yaml yml css html xml".split()
DOC_EXTENSIONS = "md markdown txt rst".split()
SOURCE_ORDERED = DOC_EXTENSIONS + "c h cpp hpp cc hh cxx hxx inl".split()
#: category: (display order, on by default, extensions)
CATEGORIES = {
    "Code": (0, True, "rs py js jsx ts tsx c h cpp cc cxx hpp hxx hh cs java kt kts go rb php swift m mm r R scala clj cljs erl ex exs hs lua pl pm sh bash zsh fish ps1 bat cmd zig nim v d f90 f95 jl ml mli fs fsx dart groovy vb vbs asm s S rgen rchit"),
    "Config": (1, True, "toml json yaml yml xml ini cfg conf env properties plist editorconfig eslintrc prettierrc babelrc nvmrc dockerignore gitattributes"),
    "Docs": (2, True, "md markdown txt rst adoc org tex latex rdoc pod"),
    "Styles": (3, True, "css scss sass less styl stylus pcss"),
    "Markup": (4, True, "html htm vue svelte erb ejs hbs handlebars pug jade slim haml twig jinja jinja2 mustache njk astro"),
    "Other": (5, True, ""),
    "Binary": (6, False, "exe dll obj o so dylib a lib pdb class pyc pyo wasm bin dat db sqlite mdb"),
    "Media": (7, False, "png jpg jpeg gif ico bmp tiff tif webp avif mp3 mp4 wav flac ogg avi mkv mov wmv webm aac m4a"),
    "Archive": (8, False, "zip tar gz bz2 xz 7z rar lz lzma zst cab dmg iso jar war ear"),
    "Font": (9, False, "ttf otf woff woff2 eot"),
    "Generated": (10, False, "pdf map min bundle chunk"),
}
#: roles in packing order; the number is the role's
ROLES = ["Source", "Test", "Example", "ShaderAsset", "Docs", "Generated"]
ROLE_PRECEDENCE = ["Generated", "Test", "Example", "ShaderAsset", "Docs", "Source"]
FOLDER_SIGNALS = {
    "Generated": "generated vendor vendors thirdparty external extern deps dependencies",
    "Test": "test tests testing spec specs",
    "Example": "example examples demo demos sample samples",
    "ShaderAsset": "shader shaders asset assets resource resources texture textures model models media",
    "Docs": "doc docs documentation",
    "Source": "src source sources include includes lib libs core",
}
FILE_SIGNALS = {"Generated": "generated vendor thirdparty", "Test": "test tests spec specs", "Example": "example demo sample"}
ASSET_EXTENSIONS = "glsl vert frag geom comp tesc tese rgen rchit rmiss rahit rint rcall mesh task hlsl fx fxh metal wgsl spv png jpg jpeg gif bmp tga hdr exr dds ktx ktx2 svg ico obj fbx gltf glb dae ply stl wav mp3 ogg flac mp4 mov webm".split()
#: pixel thresholds of the level-of-detail ladder
MERGE_PX, LABEL_PX, CARD_PX, DETAIL_PX, FULL_PX, CODE_MIN_W, LABEL_MIN_W = 4.0, 20.0, 80.0, 250.0, 700.0, 300.0, 60.0
FONT_PX, MIN_TEXT_FONT_PX = 12.0, 4.0
CHUNK_LINES = 60
SEARCH_LIMIT = 12
MAX_RETAINED_BYTES = 8 * 1024 * 1024
TEXT_MARGIN, CHAR_WIDTH, BODY_PAD, PAGE_W = 12.0, 0.62, 6.0, 640.0
HISTORY = 64
#: colours, 0xRRGGBB
TEXT_COLOUR = 0xD8D8D8
SYNTAX_COLOURS = {"Keyword": 0xC586C0, "Function": 0xDCDCAA, "Type": 0x4EC9B0, "String": 0xCE9178, "Comment": 0x6A9955, "Number": 0xB5CEA8, "Property": 0x9CDCFE}
HEAT, DEPTH_FILL, CODE_FILL = (0x2A2A2E, 0xB03030), (0x17171B, 0x3C3C46), 0x101014
FILE_TINT, FILE_BLEND = 0x443828, 0.25
DOC_TINT, TEST_TINT, FOLDER_BLEND = 0x3060A0, 0x306030, 0.12
TYPE_BLEND = {"File": 0.35, "Item": 0.25, "Leaf": 0.18}
DOC_FOLDERS, TEST_FOLDERS = ["docs", "doc", "documentation"], ["test", "tests", "spec", "specs", "__tests__"]
EXTENSION_TINTS = {
    0xC06030: "rs", 0xC0B030: "js mjs cjs", 0xD0A030: "jsx", 0x3080D0: "ts mts cts", 0x4070C0: "tsx", 0x30A060: "py", 0xC03040: "rb", 0x30B0B0: "go", 0xB04030: "java", 0xA050C0: "kt kts",
    0xE06030: "swift", 0x5070A0: "c h", 0x5060C0: "cpp cc cxx hpp hxx hh", 0x7050B0: "cs", 0xD05030: "html htm", 0xC040A0: "css", 0xB050A0: "scss sass less", 0x40B070: "vue", 0xD04020: "svelte",
    0x908040: "json", 0x906050: "yaml yml", 0x807060: "toml", 0x808060: "xml", 0x4080C0: "md markdown", 0x808080: "txt rst", 0x50A040: "sh bash zsh fish", 0xC08030: "sql", 0x3040C0: "lua",
    0x7060B0: "php", 0x3060C0: "r", 0x6040A0: "ex exs", 0xD0A020: "zig", 0x40A0C0: "dart", 0xC03020: "scala",
}
OTHER_TINT = 0x606068
#: kinds of highlighted text, by the first part of a capture's name; four names are matched whole
CAPTURES = {"Keyword": "keyword conditional repeat include exception", "Function": "function", "Type": "type constructor", "String": "string escape", "Comment": "comment", "Number": "constant number", "Property": "property"}
WHOLE_CAPTURES = {"text.title": "Type", "text.literal": "String", "text.uri": "Property", "text.reference": "Property"}
PACK_FACTORS = [0.5, 0.625, 0.75, 0.875, 1.0, 1.125, 1.5, 2.0, 3.0]
# -------------------------------------------------------------------------------------------
