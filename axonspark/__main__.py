from axonspark.cli import main

raise SystemExit(main())
