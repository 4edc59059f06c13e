from .surprisal_stream import start_surprisal_stream, stream_totals

__all__ = ["start_surprisal_stream", "stream_totals"]
