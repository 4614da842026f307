"""Schemas of the library's tables. Times are whole milliseconds; every table of cues carries its order."""

from __future__ import annotations

CUE = "track string, ord bigint, cue_index bigint, start_ms bigint, end_ms bigint, text string"
FRAGMENT = "media_id string, frag_id bigint, file string, start_ms bigint, end_ms bigint"
SEGMENT = "media_id string, chunk_no bigint, seg_no bigint, start_ms bigint, end_ms bigint"
AUDIO = "media_id string, ord bigint, start_ms bigint, sample_rate int, pcm array<float>"
CALL = "track string, call_seq bigint, name string, pos bigint, first_text string, second_text string"
TIMELINE = "timeline array<struct<id:bigint,file:string,start:double,end:double>>, metadata struct<input_file:string,total_duration:double,sample_rate:int,fragment_count:int,output_dir:string>, fragments_dir string"
EXPORT = "input_file string, total_duration double, sample_rate int, fragment_count int, output_dir string, fragments array<struct<id:bigint,file:string,start:double,end:double>>"
CHECKPOINT = (
    "version string, inputFile string, timestamp bigint, windowStartPosition bigint, "
    "progress struct<totalSubtitles:bigint,finishedSubtitles:bigint,refinedSubtitles:bigint,rounds:bigint,noProgressRounds:bigint,llmCalls:bigint>, "
    "subtitles array<struct<pos:bigint,start_ms:bigint,end_ms:bigint,text:string,state:string,first_text:string,second_text:string>>"
)
