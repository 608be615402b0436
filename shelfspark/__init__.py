"""Spark operators for shared media libraries: inventory, queues, accounts, access, progress."""
