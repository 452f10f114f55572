"""Texts shown to users, as Column builders: names of stages, evidence and reasons, progress, notes, warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capsort.functions.columns import size_text

#: Shown names of processing stages.
STAGES = {"preProcessing": "写真の前処理中", "imageAlignment": "画像の位置合わせ中", "pointCloudGeneration": "点群の生成中", "meshGeneration": "メッシュの生成中", "textureMapping": "テクスチャの貼り付け中", "optimization": "最適化中"}
#: Shown names of evidence kinds.
EVIDENCE = {"folder": "フォルダ分け", "time": "撮影時刻", "sequence": "ファイル名の連番", "gps": "GPS 位置", "altitude": "GPS 高度", "heading": "撮影方位", "exposure": "露出", "visual": "見た目の近さ"}
#: Shown names of exclusion reasons.
REASONS = {"blur": "ブレ", "overexposed": "白飛び", "underexposed": "黒つぶれ", "duplicate": "ほぼ同一", "tooSmall": "画素数不足", "panorama": "パノラマ", "unreadable": "読み取り失敗"}
#: Signal numbers with name and meaning.
SIGNALS = {
    6: "SIGABRT — 内部エラーによる中断", 11: "SIGSEGV — 不正なメモリアクセス", 10: "SIGBUS — 不正なメモリアクセス", 4: "SIGILL — 不正な命令",
    9: "SIGKILL — メモリ不足などで OS に強制終了された可能性", 15: "SIGTERM — 外部から終了された", 2: "SIGINT — 中断された",
}
#: Prefixes by severity.
SEVERITIES = {"info": "", "warning": "警告: ", "error": "問題: "}
#: Path parts that mark cloud folders.
CLOUD = ("/Library/Mobile Documents/", "/Library/CloudStorage/", "/Volumes/GoogleDrive/")

#: Parts of messages that tell of a failed model compilation.
FAILED_COMPILATION = ("ANECCompile", "MILCompilerForANE", "com.apple.e5rt.e5bundlecache", "MPSGraphExecutable", "manifest.plist")


def named(value: Column, names: dict) -> Column:
    """The name of a value; null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), value)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def is_cloud_path(path: Column) -> Column:
    return any_of(path, CLOUD)


def is_compilation_failure(message: Column) -> Column:
    return any_of(message, FAILED_COMPILATION)


def remaining_text(seconds: Column) -> Column:
    """Remaining time in whole minutes and hours; under a minute is said so."""
    total = F.floor(F.greatest(seconds, F.lit(0.0)) / 60 + 0.5).cast("long")
    hours, minutes = F.floor(total / 60), total % 60
    short = F.concat(F.lit("残り約 "), total.cast("string"), F.lit(" 分"))
    long_ = F.concat(F.lit("残り約 "), hours.cast("string"), F.lit(" 時間"), F.when(minutes > 0, F.concat(F.lit(" "), minutes.cast("string"), F.lit(" 分"))).otherwise(""))
    return F.when(seconds.isNull(), None).when(seconds < 60, "残り 1 分未満").when(total < 60, short).otherwise(long_)


def progress_text(stage: Column, remaining: Column) -> Column:
    """Stage and remaining time, as far as known; null if neither is."""
    return F.nullif(F.concat_ws(" — ", named(stage, STAGES), remaining_text(remaining)), F.lit(""))


def progress_phrase(last: Column) -> Column:
    return F.when(last.isNull(), "").otherwise(F.concat(F.lit("（進捗 "), F.bround(last * 100).cast("long").cast("string"), F.lit("% 付近）")))


def signal_name(signal: Column) -> Column:
    known = named(signal.cast("int"), SIGNALS)
    return F.concat(F.lit("シグナル "), signal.cast("string"), F.coalesce(F.concat(F.lit(": "), known), F.lit("")))


def severity_text(severity: Column, message: Column) -> Column:
    return F.concat(named(severity, SEVERITIES), message)


def branch_name(branch: Column) -> Column:
    return F.when(branch == "main", "main（安定版）").otherwise(F.concat(branch, F.lit("（開発版）")))


def folder_notes(images: Column, most: Column, placeholders: Column, cloud: Column) -> Column:
    """Notes on a folder: always the number of images, then the warnings that hold."""
    n, m, p = (c.cast("string") for c in (images, most, placeholders))
    over = F.concat(F.lit("警告: 入力画像 "), n, F.lit(" 枚はこの Mac の上限 "), m, F.lit(" 枚を超えています。失敗する場合は写真を "), m, F.lit(" 枚以下に減らしてください。"))
    fits = F.concat(F.lit("入力画像: "), n, F.lit(" 枚（この Mac の上限: "), m, F.lit(" 枚）"))
    none = "警告: 画像ファイルが 1 枚も見つかりません。写真が直下にあるフォルダを選んでください（サブフォルダの中は対象外です）。"
    stubs = F.concat(F.lit("警告: iCloud の未ダウンロードファイル（.icloud）が "), p, F.lit(" 個あります。Finder でフォルダを「今すぐダウンロード」するか、ローカル（例: ~/Pictures）へコピーしてから実行してください。"))
    synced = "注意: 入力フォルダはクラウド同期領域（iCloud Drive・Google ドライブなど）にあります。処理中にファイルの実体が退避されると読み取りに失敗するため、写真はローカルへ複製してから処理します。"
    return F.array_compact(F.array(F.when(images > most, over).otherwise(fits), F.when(images == 0, none), F.when(placeholders > 0, stubs).when(cloud, synced)))


def start_note(n: Column, folder: Column) -> Column:
    return F.concat(F.lit("写真 "), n.cast("string"), F.lit(" 枚をローカルへコピーします（"), folder, F.lit("）。"))


def placeholder_note(n: Column) -> Column:
    return F.concat(F.lit("警告: 未ダウンロードの写真（.icloud）が "), n.cast("string"), F.lit(" 個あるためコピーできません。Finder でフォルダを「今すぐダウンロード」してから実行してください。"))


def finish_note(n: Column, size: Column) -> Column:
    return F.concat(F.lit("ローカルへのコピーが完了しました（"), n.cast("string"), F.lit(" 枚・"), size_text(size), F.lit("）。処理が終わると自動的に削除します。"))


def fix_time(day: Column, clock: Column) -> Column:
    """Seconds since 1970 of a GPS day and clock, in UTC; a fraction of the seconds is dropped."""
    text = F.concat_ws(" ", day, F.substring_index(clock, ".", 1))
    return F.when(day.isNotNull() & clock.isNotNull(), F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))).cast("double"))


def signed_altitude(value: Column, ref: Column) -> Column:
    """Reference 1 is below the sea."""
    return F.when(ref == 1, -value).otherwise(value)


def error_chain(error: BaseException, most: int = 5) -> str:
    """An error's text, then one indented line for each error of its chain of causes, up to ``most``."""
    lines, at = [str(error)], error
    for depth in range(1, most + 1):
        lines.append(f"{'  ' * depth}domain={type(at).__name__} code={getattr(at, 'errno', None) or 0}")
        at = at.__cause__ or at.__context__
        if at is None:
            break
        lines.append(f"{'  ' * depth}underlying:")
    return "\n".join(lines)
